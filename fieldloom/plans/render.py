"""Text of a contract in each layout, as one expression per layout. A layout is a sequence of literal strings and columns; both
parties are printed, the own one first, and part of the data is printed again in closing paragraphs."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import dates, numbers
from ..functions.identifiers import plate_with
from ..schema import OWN

_OWN = {f"own_{k}": v for k, v in OWN.items()}

#: Labels and connecting words are fixed values: they are what the extraction rules look for.
LAYOUTS = {
    "formal": (
        "CONTRATO DE ARRIENDO DE VEHÍCULO. Comparecen dos partes. La primera es {own_razon_social}, RUT {own_rut_empresa}, dedicada a {own_giro}, con oficinas en "
        "{own_domicilio}, que actúa por medio de su representante {own_nombre_representante}, cédula {own_rut_representante}, en adelante LA PROPIETARIA. La segunda es "
        "{razon_social}, RUT {rut_empresa}, dedicada a {giro}, con oficinas en {domicilio}, que actúa por medio de su representante {nombre_representante}, cédula "
        "{rut_representante}, en adelante LA USUARIA. Primero: se entrega en uso un vehículo {marca}, modelo {modelo}, fabricado el año {ano} y con patente {plate}. "
        "Segundo: el uso empieza el {start} y termina el {end}, esto es, {plazo_meses} meses. Tercero: LA USUARIA paga {amount} por mes, por adelantado. Cuarto: como "
        "respaldo se firma el pagaré número {numero_pagare}. Quinto: las partes se someten a los tribunales de {ciudad}."
    ),
    "tabular": (
        "CONTRATO DE ARRENDAMIENTO {own_razon_social} · RUT {own_rut_empresa} · {ciudad} 1. ARRENDATARIO Razón social {razon_social} RUT empresa {rut_empresa} "
        "Giro {giro} Domicilio {domicilio} Representante legal {nombre_representante} C.I. N° {rut_representante} 2. VEHÍCULO Placa patente {plate} Marca {marca} "
        "Modelo {modelo} Año {ano} 3. CONDICIONES Fecha de inicio {start} Fecha de término {end} Plazo {plazo_meses} meses Renta mensual {amount} Pagaré N° "
        "{numero_pagare} 4. CLÁUSULAS El arrendatario recibe de {own_razon_social} el vehículo indicado y garantiza el pago con el pagaré N° {numero_pagare}. "
        "Firman {own_nombre_representante} y {nombre_representante}."
    ),
    "compacta": (
        "CONTRATO DE ARRENDAMIENTO ARRENDADORA: {own_razon_social} | RUT {own_rut_empresa} | LUGAR: {ciudad} DATOS R. SOCIAL: {razon_social} RUT EMP.: {rut_empresa} "
        "GIRO: {giro} DOMICILIO: {domicilio} REP. LEGAL: {nombre_representante} RUT: {rut_representante} VEHÍCULO PPU: {plate} MARCA: {marca} MODELO: {modelo} "
        "AÑO: {ano} CONDICIONES INICIO: {start} TÉRMINO: {end} PLAZO: {plazo_meses} meses RENTA MENSUAL: {amount} PAGARÉ N°: {numero_pagare} ESTIPULACIONES Se "
        "arrienda el {marca} {modelo} {ano}, PPU {plate}, desde el {start} hasta el {end}, por una renta mensual de {amount}. Garantía: pagaré N° {numero_pagare}. "
        "Firman {own_nombre_representante} y {nombre_representante}."
    ),
}


def _printed(layout: str) -> dict[str, Column]:
    start, end = F.col("fecha_inicio").cast("date"), F.col("fecha_termino").cast("date")
    fee, plate = F.col("valor_cuota"), F.col("ppu")
    if layout == "formal":
        return {"start": dates.in_words(start), "end": dates.in_words(end), "amount": numbers.in_words(fee), "plate": plate_with(plate, "·")}
    if layout == "tabular":
        return {"start": dates.in_digits(start), "end": dates.in_digits(end), "amount": numbers.with_symbol(fee), "plate": plate_with(plate, "-")}
    return {"start": dates.in_digits(start, "-"), "end": dates.in_digits(end, "-"), "amount": numbers.with_suffix(fee), "plate": plate_with(plate)}


def text_of(layout: str) -> Column:
    """The layout's text over columns of contracts."""
    printed = _printed(layout)
    parts = []
    for literal, name in re.findall(r"([^{}]*)(?:\{(\w+)\})?", LAYOUTS[layout]):
        if literal:
            parts.append(F.lit(literal))
        if name:
            parts.append(F.lit(_OWN[name]) if name in _OWN else printed[name] if name in printed else F.col(name).cast("string"))
    return F.concat(*parts)


def render(rows: DataFrame) -> DataFrame:
    """Contracts with their texto, by plantilla."""
    text = None
    for layout in LAYOUTS:
        hit = F.col("plantilla") == layout
        text = F.when(hit, text_of(layout)) if text is None else text.when(hit, text_of(layout))
    return rows.withColumn("texto", text)
