"""Fields, record schemas and fixed values of the data model."""

from __future__ import annotations

from pyspark.sql import types as T

#: The fifteen fields in schema order, with their types.
FIELD_TYPES = {
    "ppu": "string", "marca": "string", "modelo": "string", "ano": "int",
    "razon_social": "string", "rut_empresa": "string", "giro": "string", "domicilio": "string",
    "nombre_representante": "string", "rut_representante": "string",
    "fecha_inicio": "string", "fecha_termino": "string", "plazo_meses": "int", "valor_cuota": "bigint", "numero_pagare": "string",
}
FIELDS = tuple(FIELD_TYPES)
STATES = ("correcto", "incorrecto", "omitido")
DIMENSIONS = ("plantilla", "perfil_escaneo")
UNKNOWN = "desconocido"

_TEXT, _LONG, _INT, _DOUBLE = T.StringType(), T.LongType(), T.IntegerType(), T.DoubleType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRUTH = _struct(
    ord=_LONG, id_documento=_TEXT, plantilla=_TEXT, perfil_escaneo=_TEXT, semilla=_INT,
    formatos_usados=_struct(fecha=_TEXT, monto=_TEXT, patente=_TEXT, etiqueta_rut_persona=_TEXT),
    archivos=_struct(pdf=_TEXT, escaneos=T.ArrayType(_TEXT)), campos=T.MapType(_TEXT, _TEXT),
)
PREDICTION = _struct(ord=_LONG, id_documento=_TEXT, origen=_TEXT, metodo=_TEXT, segundos=_DOUBLE, caracteres=_INT, campos=T.MapType(_TEXT, _TEXT))
COMPARISON = _struct(ord=_LONG, id_documento=_TEXT, ord_campo=_INT, campo=_TEXT, esperado=_TEXT, obtenido=_TEXT, estado=_TEXT, similitud=_DOUBLE)

# Fixed values. Sections are in the order of the data model.

RUT_COMPANY_FIRST, RUT_PERSON_FIRST = 99_000_000, 50_000_000
PLATE_LETTERS, PLATE_FIRST_LETTERS = "BCDFGHJKLPRSTVWXYZ", "XYZ"
FIRST_YEAR, LAST_YEAR = 2016, 2025
FEE_MIN, FEE_MAX, FEE_STEP = 180_000, 950_000, 5_000
TERMS = (12, 18, 24, 36, 48, 60)
START_MIN, START_MAX = "2021-01-01", "2025-06-30"
NOTE_MIN, NOTE_MAX = 100_000, 999_999
NATIVE_TEXT_MIN = 200
RUT_CONTEXT = 60

#: Data of the own party, which every contract prints and no extraction may return.
OWN = {
    "razon_social": "Flota Meridiano SpA",
    "rut_empresa": "99.000.001-8",
    "giro": "Arriendo de vehículos motorizados sin chofer",
    "domicilio": "Avenida Los Pinos 1450, piso 6, Providencia",
    "nombre_representante": "Andrés Vergara Solís",
    "rut_representante": "50.000.001-5",
}

LAYOUTS = {"formal": 0.40, "tabular": 0.30, "compacta": 0.30}
FORMATS = {
    "formal": ("textual", "palabras", "punto_medio", "cédula"),
    "tabular": ("numerica_barra", "simbolo_peso", "guion", "C.I. N°"),
    "compacta": ("numerica_guion", "sufijo_punto_guion", "sin_separador", "RUT"),
}

#: Scan profiles: dpi, rotation degrees, noise sigma, salt and pepper rate, blur radius, brightness, contrast, vignette, JPEG quality.
PROFILES = {
    "limpio": {"dpi": 300, "rotation": (-0.3, 0.3), "sigma": 2.0, "specks": 0.0, "blur": 0.3, "brightness": (0.98, 1.02), "contrast": (0.98, 1.02), "vignette": 0.05, "jpeg": 92},
    "medio": {"dpi": 200, "rotation": (-1.2, 1.2), "sigma": 8.0, "specks": 0.0015, "blur": 0.7, "brightness": (0.90, 1.08), "contrast": (0.88, 1.10), "vignette": 0.18, "jpeg": 75},
    "degradado": {"dpi": 150, "rotation": (-2.5, 2.5), "sigma": 16.0, "specks": 0.0060, "blur": 1.1, "brightness": (0.80, 1.15), "contrast": (0.78, 1.18), "vignette": 0.30, "jpeg": 55},
}
NO_PROFILE, MIXED_PROFILE = "ninguno", "mixto"

# Vocabularies of made-up contracts. Nothing is compared with them but what is drawn from them.
FIRST_NAMES = (
    "Abelardo", "Belén", "Cristóbal", "Delfina", "Evaristo", "Florencia", "Gaspar", "Herminia", "Iván", "Josefa", "Kevin", "Leonor",
    "Mateo", "Noemí", "Octavio", "Paulina", "Ramiro", "Soledad", "Teodoro", "Úrsula", "Vicente", "Wanda", "Yasna", "Zacarías",
)
SURNAMES = (
    "Acuña", "Briceño", "Concha", "Dinamarca", "Echeverría", "Farías", "Godoy", "Henríquez", "Inostroza", "Jofré", "Krause", "Leiva",
    "Miranda", "Nahuel", "Oyarzún", "Pizarro", "Quezada", "Retamal", "Salgado", "Troncoso", "Ugarte", "Villalobos", "Yáñez", "Zúñiga",
)
COMPANY_CORES = (
    "Arco Boreal", "Brisa del Lago", "Cerro Pardo", "Dos Ríos", "Estrella Polar", "Fuente Grande", "Gran Estuario", "Huerto Viejo",
    "Isla Mayor", "Jardín Seco", "Karst", "Llano Alto", "Mar Interior", "Nube Gris", "Olivar Nuevo", "Piedra Clara",
)
COMPANY_TRADES = ("Agrícola", "Consultores", "Empaques", "Forestal", "Importadora", "Metalurgia", "Pesquera", "Textil")
COMPANY_SUFFIXES = ("S.A.", "SpA", "Ltda.", "E.I.R.L.", "Cía. Ltda.")
TRADES = (
    "Cultivo y venta de hortalizas", "Reparación de embarcaciones", "Fabricación de envases de vidrio", "Asesorías contables y tributarias",
    "Venta de repuestos y neumáticos", "Procesamiento de productos del mar", "Elaboración de telas y vestuario", "Explotación de bosques",
)
STREETS = (
    "Almirante Rojas", "Buenos Vientos", "Camino Real", "Doctor Silva", "Esmeralda", "Flor de Lis", "General Prieto", "Hermanos Lobos",
    "Independencia", "Juan Godoy", "Kilómetro Uno", "Libertad",
)
STREET_TYPES = ("Calle", "Avenida", "Pasaje")
COMMUNES = (
    "Arica", "Buin", "Calama", "Dalcahue", "El Monte", "Frutillar", "Graneros", "Hualpén", "Illapel", "Lota", "Melipilla", "Nogales", "Osorno",
    "Pucón", "Quillón",
)
CITIES = ("Arica", "Chillán", "Copiapó", "Curicó", "Iquique", "Osorno", "Talca", "Valdivia")
BRANDS = {
    "Aldebarán": ("Uno", "Dos", "Max"),
    "Boreas": ("B-10", "B-20", "B-30 Plus"),
    "Cóndor": ("Cima", "Valle", "Puna"),
    "Drakon": ("Serie A", "Serie C", "Serie Z"),
    "Estela": ("Faro", "Faro Largo", "Muelle"),
    "Fénix": ("700", "900", "1100 Carga"),
}
MONTHS = ("enero", "febrero", "marzo", "abril", "mayo", "junio", "julio", "agosto", "septiembre", "octubre", "noviembre", "diciembre")
