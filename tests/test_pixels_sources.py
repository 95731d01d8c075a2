import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldloom import schema as S
from fieldloom.operators import images, pixels
from fieldloom.plans import render, synth
from fieldloom.sources import documents
from fieldloom.streaming import ingest


def table(spark, **named):
    rows = [(k, y, x, int(v)) for k, a in named.items() for y, row in enumerate(a) for x, v in enumerate(row)]
    return spark.createDataFrame(rows, "img_id string, y int, x int, v int")


def bars(height=600, width=480):
    page = np.full((height, width), 255, np.uint8)
    for y in range(60, 540, 40):
        page[y : y + 12, 60:420] = 0
    return page


def test_pixel_tables_agree_with_kernels(spark):
    rng = np.random.default_rng(3)
    two = np.array([[30] * 100] * 50 + [[220] * 100] * 50, np.uint8)
    named = {"two": two, "flat": np.full((4, 4), 9, np.uint8), "noise": rng.integers(0, 256, (12, 17)).astype(np.uint8)}
    t = table(spark, **named)
    got = {r.img_id: r.threshold for r in pixels.otsu(t).collect()}
    assert got == {k: images.otsu(v) for k, v in named.items()} and 30 <= got["two"] < 220 and got["flat"] == 128
    assert {r.v for r in pixels.binarise(t).where("img_id = 'noise'").collect()} == {0, 255}
    filtered = pixels.median3(t.where("img_id = 'noise'")).collect()
    want = images.median3(named["noise"])
    assert len(filtered) == want.size and all(r["median"] == want[r.y, r.x] for r in filtered)
    share = pixels.speck_ratio(pixels.median3(t)).where("img_id = 'noise'").first().specks
    assert share == pytest.approx(images.specks(named["noise"], want))
    ink = (255 - named["noise"].astype(float)).sum(axis=1)
    assert pixels.profile_score(t).where("img_id = 'noise'").first().score == pytest.approx(np.var(np.diff(ink)))
    assert pixels.vignette(t.where("img_id = 'two'"), 0.3).where("y = 0 and x = 0").first().v == 21


def test_specks_grow(spark):
    t = table(spark, page=np.full((40, 40), 128))
    share = [pixels.speck_ratio(pixels.median3(pixels.salt_and_pepper(t, r))).first().specks for r in (0.01, 0.1)]
    assert share[0] < share[1]


@pytest.mark.parametrize("angle", (-2, -1, 1, 2))
def test_skew_is_found(angle):
    tilted = np.clip(images.rotate(bars(), -angle), 0, 255).astype(np.uint8)
    assert abs(images.skew(tilted) - angle) <= 0.35


def test_prepare_and_degrade(spark):
    page = bars()
    harm = [np.abs(images.degrade(page, S.PROFILES[p], 7).astype(float) - page).mean() for p in S.PROFILES]
    assert harm == sorted(harm)
    assert (images.degrade(page, S.PROFILES["medio"], 7) == images.degrade(page, S.PROFILES["medio"], 7)).all()
    rows = spark.createDataFrame([("a", 600, 480, bytearray(page.tobytes()))], "img_id string, height int, width int, pixels binary")
    out = images.map_images(rows, images.prepare).first()
    assert (out.height, out.width) == (1200, 960) and set(out.pixels) <= {0, 255}
    dark = np.linspace(120, 255, 480)[None, :].repeat(600, 0).astype(np.uint8)
    assert images.flatten_light(dark).std() < dark.std() / 3


def test_policy(spark):
    rows = spark.createDataFrame([("/x/a.PDF", 200), ("/x/b.pdf", 199), ("/x/c.Jpg", None), ("/x/d.txt", 900)], "path string, n int")
    auto = [r.e for r in rows.select(documents.engine_for(F.col("path"), F.col("n")).alias("e")).collect()]
    assert auto == ["nativo", "tesseract", "tesseract", None]
    given = [r.e for r in rows.select(documents.engine_for(F.col("path"), F.col("n"), "documentai").alias("e")).collect()]
    assert given == ["documentai"] * 3 + [None]
    with pytest.raises(Exception, match="no embedded text"):
        rows.select(documents.engine_for(F.col("path"), F.col("n"), "nativo")).collect()
    with pytest.raises(ValueError):
        documents.engine_for(F.col("path"), F.col("n"), "other")
    with pytest.raises(Exception, match="no MIME"):
        rows.select(documents.mime_of(F.col("path"))).collect()
    ids = spark.createDataFrame([("/l/SINT-0001_p02.jpg",), ("file:/l/X.tar.pdf",)], "p string").select(documents.id_of(F.col("p")).alias("i")).collect()
    assert [r.i for r in ids] == ["SINT-0001", "X.tar"]


def test_scan_and_read_with_plugins(spark, tmp_path, monkeypatch):
    for name, content in {"a.PDF": b"largo " * 60, "b.pdf": b"corto", "c.jpg": b"imagen", "d.txt": b"no"}.items():
        (tmp_path / name).write_bytes(content)
    monkeypatch.setattr(documents, "_readers", {})
    with pytest.raises(documents.EngineMissing):
        documents.read(documents.scan(spark, str(tmp_path)))
    documents.register("nativo", lambda b: [b.decode()])
    documents.register("tesseract", lambda b: ["ocr", b.decode()])
    got = {r.id_documento: (r.metodo, r.texto[:9]) for r in documents.read(documents.scan(spark, str(tmp_path))).collect()}
    assert got == {"a": ("nativo", "largo lar"), "b": ("tesseract", "ocr corto"), "c": ("tesseract", "ocr image")}


def test_stream_reads_what_a_batch_reads(spark, tmp_path):
    rows = render.render(synth.drawn(spark, 12, 5)).select("ord", "id_documento", "texto", F.lit("2024-01-01 10:00:00").cast("timestamp").alias("ts"))
    rows.union(rows.limit(2)).write.json(f"{tmp_path}/in")
    stream = ingest.texts(spark, f"{tmp_path}/in")
    q = ingest.write(ingest.predictions(stream), f"{tmp_path}/out", f"{tmp_path}/check")
    q.awaitTermination()
    out = spark.read.json(f"{tmp_path}/out")
    assert out.count() == 12 and out.select("campos.giro").where("giro = ''").count() == 0


def test_pdfs_and_bitmaps_without_libraries():
    import zlib

    from fieldloom.sources import bitmap, pdf

    text = "Renta (mensual) \\ $205.000 · Ñuñoa N° 1 " * 300
    made = pdf.write(text, "título")
    assert " ".join(" ".join(pdf.read(made)).split()) == " ".join(text.split()) and pdf.count_pages(made) == len(pdf.read(made)) > 1
    body = b"BT (a\\051\\(b) Tj [(c) -20 (d)] TJ ET"
    packed = b"%PDF-1.4 /Font /WinAnsiEncoding << /Filter /FlateDecode >> stream\n" + zlib.compress(body) + b"\nendstream"
    assert pdf.read(packed) == ["a)(b\ncd"] and pdf.read(pdf.write("")) == [""]
    for bad in (b"PK", b"%PDF-1.4 /Font /Identity-H"):
        with pytest.raises(ValueError):
            pdf.read(bad)
    image = np.random.default_rng(1).integers(0, 256, (7, 5)).astype(np.uint8)
    assert (bitmap.read(bitmap.write(image)) == image).all() and (documents.decode(bitmap.write(image)) == image).all()
    assert documents.page_count(bitmap.write(image)) == 1 and documents.page_count(made) == pdf.count_pages(made)


def test_recognition_gets_prepared_pages(spark, monkeypatch):
    """PDFs are drawn and images decoded, every page is prepared, and the cloud engine gets files as they are."""
    from fieldloom.sources import bitmap, pdf

    def recognise(image):
        return f"{image.shape[0]}x{image.shape[1]} {sorted(set(image.ravel().tolist()))}"

    monkeypatch.setattr(documents, "_readers", {})
    documents.register("nativo", pdf.read)
    drawn = [bars(), bars()]
    documents.register("tesseract", documents.ocr_reader(recognise, draw=lambda content, dpi: drawn))
    rows = [("/l/a.pdf", bytearray(pdf.write("largo " * 60))), ("/l/b.pdf", bytearray(pdf.write("corto"))), ("/l/c_p01.bmp", bytearray(bitmap.write(bars()))), ("/l/d.txt", bytearray(b"x"))]
    files = spark.createDataFrame(rows, "path string, content binary")
    got = {r.id_documento: (r.metodo, r.texto) for r in documents.read(files).collect()}
    page = "1200x960 [0, 255]"
    assert got == {"a": ("nativo", " ".join(["largo"] * 60)), "b": ("tesseract", f"{page} {page}"), "c": ("tesseract", page)}
    documents.register("documentai", documents.cloud_reader(lambda r: f"{r['name']} {r['raw_document']['mime_type']} {r['process_options']['ocr_config']}", "p"))
    cloud = [r.texto for r in documents.read(files.where("path like '%c_p01%'"), "documentai").collect()]
    assert cloud == ["p image/bmp {'enable_native_pdf_parsing': True}"]
    assert not documents.cloud_configured({}) and documents.cloud_configured(dict.fromkeys(documents.CLOUD_VARIABLES, "x"))
    with pytest.raises(Exception, match="no embedded text"):
        documents.read(files, "nativo").collect()


def test_scans_of_pdfs(spark):
    from fieldloom.sources import bitmap, sinks

    files = spark.createDataFrame([("pdf/A-1.pdf", bytearray(b"%PDF")), ("pdf/B-2.pdf", bytearray(b"%PDF"))], "path string, content binary")
    profile = F.when(F.col("path").contains("A-1"), "degradado").otherwise(S.NO_PROFILE)
    drawn = [bars(60, 48), bars(60, 48)]
    made = sinks.scans(files, profile, 3, draw=lambda content, dpi: drawn, encode=lambda image, quality: ("bmp", bitmap.write(image)))
    got = {r.path: bitmap.read(bytes(r.content)) for r in made.collect()}
    assert sorted(got) == ["escaneos/A-1_p01.bmp", "escaneos/A-1_p02.bmp"]
    assert not (got["escaneos/A-1_p01.bmp"] == got["escaneos/A-1_p02.bmp"]).all()
    assert {r.path: bitmap.read(bytes(r.content)).tolist() for r in made.collect()} == {k: v.tolist() for k, v in got.items()}
    with pytest.raises(Exception, match="EngineMissing|PyMuPDF"):
        sinks.scans(files, F.lit("medio")).collect()
