"""Pictures against plain loops, planted shapes and the codec of the JVM."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from paperloom.functions import constants as K
from paperloom.operators import checks, jpeg, pixels, quality
from paperloom.plans import picture_queries
from paperloom.sources import files as sources
from paperloom.sources import providers


def picture(h=45, w=53):
    rng = np.random.default_rng(0)
    y, x = np.mgrid[0:h, 0:w]
    image = np.clip(np.stack((128 + 100 * np.sin(x / 7) + y, 128 + 90 * np.cos(y / 5), x * 4), axis=2) + rng.normal(0, 10, (h, w, 3)), 0, 255).astype(np.uint8)
    image[10:20, 10:30] = (255, 0, 0)
    return image


def saved(spark, image, quality_share, progressive=False):
    """A JPEG file by the JVM's codec."""
    jvm, (h, w, n) = spark._jvm, image.shape
    values = spark.sparkContext._gateway.new_array(jvm.int, image.size)
    for i, v in enumerate(image.ravel().tolist()):
        values[i] = v
    held = jvm.java.awt.image.BufferedImage(w, h, 5 if n == 3 else 10)
    held.getRaster().setPixels(0, 0, w, h, values)
    writer = jvm.javax.imageio.ImageIO.getImageWritersByFormatName("jpg").next()
    options = writer.getDefaultWriteParam()
    options.setCompressionMode(2)
    options.setCompressionQuality(float(quality_share))
    if progressive:
        options.setProgressiveMode(1)
    out = jvm.java.io.ByteArrayOutputStream()
    stream = jvm.javax.imageio.ImageIO.createImageOutputStream(out)
    writer.setOutput(stream)
    writer.write(None, jvm.javax.imageio.IIOImage(held, None, None), options)
    stream.flush()
    return bytes(out.toByteArray())


def opened(spark, data):
    image = spark._jvm.javax.imageio.ImageIO.read(spark._jvm.java.io.ByteArrayInputStream(data))
    h, w, n = image.getHeight(), image.getWidth(), image.getRaster().getNumBands()
    return np.array(list(image.getRaster().getPixels(0, 0, w, h, None)), int).reshape(h, w, n)


@pytest.mark.parametrize("share", [0.9, 0.5, 0.2])
def test_jpeg_as_the_codec_reads_and_writes(spark, share):
    image = picture()
    data = saved(spark, image, share)
    want = opened(spark, data)
    assert np.abs(jpeg.decoded(data).astype(int) - want).max() <= 2
    mine = np.abs(jpeg.recompressed(image, int(100 * share)).astype(int) - want)
    # Coefficients that lie between two steps may be rounded otherwise.
    assert mine.mean() < 0.8 and np.percentile(mine, 99) < 12


def test_jpegs_in_a_scan(spark, tmp_path):
    image = picture()
    grey = saved(spark, image[:, :, :1], 0.8)
    assert np.abs(jpeg.decoded(grey)[:, :, :1].astype(int) - opened(spark, grey)).max() <= 2
    whole = saved(spark, image, 0.8)
    for name, body in (("a.jpg", whole), ("b.jpeg", grey), ("c.jpg", saved(spark, image, 0.8, True)), ("d.jpg", whole[: len(whole) // 2]), ("e.jpg", whole[:2]), ("f.jpg", whole[:30] + b"\xff" + whole[31:])):
        (tmp_path / name).write_bytes(body)
    got = {r["original_filename"]: r["n"] for r in sources.scan(spark, str(tmp_path)).join(providers.read_pages(sources.scan(spark, str(tmp_path)), providers.ImagePages()), "document_id").groupBy("original_filename").agg(F.count("page").alias("n")).collect()}
    assert {"a.jpg", "b.jpeg"} <= set(got) and not {"c.jpg", "d.jpg", "e.jpg"} & set(got)
    with pytest.raises(jpeg.Unsupported):
        jpeg.decoded((tmp_path / "c.jpg").read_bytes())


def plain_block(block, table):
    """One block of 8 x 8 through the cosine transform and back, by its definition."""
    c = lambda k: math.sqrt(0.5) if k == 0 else 1.0
    wave = [[math.cos((2 * x + 1) * u * math.pi / 16) for x in range(8)] for u in range(8)]
    kept = [[0.0] * 8 for _ in range(8)]
    for u in range(8):
        for v in range(8):
            s = sum((block[y][x] - 128) * wave[u][y] * wave[v][x] for y in range(8) for x in range(8)) * c(u) * c(v) / 4
            kept[u][v] = round(s / table[u][v]) * table[u][v]
    return [[min(255, max(0, round(128 + sum(c(u) * c(v) * kept[u][v] * wave[u][y] * wave[v][x] for u in range(8) for v in range(8)) / 4))) for x in range(8)] for y in range(8)]


def test_recompression_equals_a_plain_loop(spark):
    """A grey picture: its colours are 128 everywhere, so the error is that of its brightness."""
    rng = np.random.default_rng(3)
    flat = np.full((32, 48), 200)
    flat[8:24, 8:40] = rng.integers(0, 256, (16, 32))
    table = [[max(1, min(255, (jpeg.BRIGHTNESS[8 * u + v] * 20 + 50) // 100)) for v in range(8)] for u in range(8)]
    diff = np.zeros(flat.shape)
    for y in range(0, 32, 8):
        for x in range(0, 48, 8):
            block = flat[y : y + 8, x : x + 8]
            diff[y : y + 8, x : x + 8] = np.abs(np.array(plain_block(block.tolist(), table)) - block)
    mean, percent = pixels.recompression_error(np.repeat(flat.astype(np.uint8)[:, :, None], 3, axis=2))
    assert mean == pytest.approx(diff.mean(), abs=0.02) and percent == pytest.approx(100 * (diff > 25).mean(), abs=0.2)
    assert pixels.recompression_error(np.zeros((0, 0, 3), np.uint8)) == (0.0, 0.0)
    rows = [("d", 1, 3.0, 1.51), ("e", 1, 9.0, 1.5), ("f", 2, 9.0, 9.0), ("g", 1, 0.0, None)]
    got = checks.recompression_flags(spark.createDataFrame(rows, "document_id string, page int, resave_mean double, resave_percent double")).collect()
    assert [(r["document_id"], r["flag_type"], r["severity"], r["affected_field"]) for r in got] == [("d", "recompression_artifact", "medium", None)]


def steps_to_background(ink):
    """Shortest ways by the same steps, by Dijkstra."""
    h, w = ink.shape
    steps = [(dy, dx, d) for dy in range(-2, 3) for dx in range(-2, 3) for d in [{1: 1.0, 2: K.STEP_CORNER, 5: K.STEP_KNIGHT}.get(dy * dy + dx * dx)] if d]
    best = np.where(ink, np.inf, 0.0)
    todo = [(0.0, int(y), int(x)) for y, x in zip(*np.nonzero(~ink), strict=True)]
    heapq.heapify(todo)
    while todo:
        d, y, x = heapq.heappop(todo)
        if d > best[y, x]:
            continue
        for dy, dx, step in steps:
            if 0 <= y + dy < h and 0 <= x + dx < w and d + step < best[y + dy, x + dx] - 1e-12:
                best[y + dy, x + dx] = d + step
                heapq.heappush(todo, (d + step, y + dy, x + dx))
    return best


def test_distances_are_shortest_ways():
    rng = np.random.default_rng(4)
    for share, shape in ((0.9, (20, 31)), (0.99, (17, 23)), (0.6, (9, 2)), (0.9, (1, 30)), (0.995, (40, 25))):
        ink = rng.random(shape) < share
        ink[0, 0] = False
        got, want = pixels.distance_to_background(ink), steps_to_background(ink)
        assert np.allclose(got, want)
        y, x = np.nonzero(~ink)
        straight = np.sqrt(((np.indices(shape).reshape(2, -1, 1) - np.stack((y, x))[:, None]) ** 2).sum(axis=0)).min(axis=1).reshape(shape)
        assert (np.abs(got - straight) <= 0.021 * straight + 1e-9).all()


def test_strokes_of_many_sizes_at_once():
    rng = np.random.default_rng(5)
    crops = [np.where(rng.random((int(h), int(w))) < 0.7, 0.0, 255.0) for h, w in rng.integers(6, 40, (30, 2))] + [np.full((5, 5), 9.0), np.zeros((0, 4)), np.zeros((4, 4))]
    assert pixels.stroke_widths(crops) == pytest.approx([pixels.stroke_width(c) for c in crops]) and pixels.stroke_widths(crops)[-3:] == [0, 0, 0]


def lined(angle, h=400, w=500, gap=70):
    page = np.full((h, w), 255, np.uint8)
    for y in range(20, h - 20, gap):
        page[y : y + 6, 20 : w - 20] = 0
    return pixels.rotated(page, -angle)


@pytest.mark.parametrize("angle", [0, 0.5, -1.5, 3, -7, 15, -25, 35, -44, 44])
def test_skew(angle):
    page = lined(angle)
    found = pixels.skew_angle(page.astype(float))
    assert abs(found - angle) <= 0.5 and abs(pixels.skew_angle(pixels.rotated(page, found).astype(float))) <= 0.5


def test_skew_by_rectangles():
    """Shapes without a long line: the rectangle around them."""
    page = np.full((120, 120), 255.0)
    for i in range(45):
        page[30 + i // 3 : 50 + i // 3, 20 + i] = 0
    votes = pixels.line_angles(pixels.outline(pixels.dilated(page < 9, *K.LINE_JOIN)))
    assert not len(votes) and 5 < pixels.skew_angle(page) < 25
    assert pixels.rectangle_angle(np.array([(0, 0), (0, 10), (5, 0), (5, 10)])) == pytest.approx(0)
    assert pixels.rectangle_angle(np.array([(0, 0), (10, 10), (2, -2), (12, 8)])) == pytest.approx(45)
    assert pixels.rectangle_angle(np.array([(0, 0), (1, 1)])) is None
    assert pixels.skew_angle(np.full((50, 50), 255.0)) == 0


def test_parts_are_connected():
    rng = np.random.default_rng(6)
    ink = rng.random((30, 40)) < 0.3
    seen, sizes = np.zeros(ink.shape, bool), []
    for y, x in zip(*np.nonzero(ink), strict=True):
        todo, n = [(int(y), int(x))], 0
        while todo:
            a, b = todo.pop()
            if 0 <= a < 30 and 0 <= b < 40 and ink[a, b] and not seen[a, b]:
                seen[a, b], n = True, n + 1
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
        if n:
            sizes.append(n)
    assert sorted(int(p[-1][0]) for p in pixels.parts(ink)) == sorted(sizes)


def test_dilation_equals_a_loop():
    ink = np.random.default_rng(7).random((20, 25)) < 0.1
    want = np.array([[ink[max(0, y - 1) : y + 1, max(0, x - 3) : x + 3].any() for x in range(25)] for y in range(20)])
    assert (pixels.dilated(ink, 6, 2) == want).all()


def test_pages_are_set_straight(spark):
    page = lined(5)
    rows = [("a", 1, *page.shape, 1, page.tobytes()), ("a", 2, *page.shape, 1, lined(-3).tobytes())]
    got = {r["page"]: r for r in quality.prepared(spark.createDataFrame(rows, "document_id string, page int, height int, width int, channels int, pixels binary")).collect()}
    assert abs(got[1]["skew_before"] - 5) <= 0.5 and abs(got[1]["skew_angle"]) <= 0.5 and abs(got[2]["skew_before"] + 3) <= 0.5
    assert got[1]["channels"] == 3 and len(got[1]["pixels"]) == 3 * page.size and got[1]["resave_percent"] is not None and got[2]["resave_percent"] is None


def test_strokes_join_pictures_words_and_fields(spark):
    page = np.full((100, 200), 255, np.uint8)
    for i in range(6):
        page[10 + 12 * i + 2 : 10 + 12 * i + 5, 10:60] = 0
    page[12:22, 100:150] = 0
    words = spark.createDataFrame([("d", 1, i, "w", 10, 10 + 12 * i, 50, 12) for i in range(6)] + [("d", 1, 6, "low", 0, 0, 5, 5), ("d", 1, 7, "outside", 190, 90, 50, 50)], "document_id string, page int, word_idx int, text string, x int, y int, width int, height int")
    fields = spark.createDataFrame([("d", "bold", 100, 9, 50, 16), ("d", "like", 10, 10, 50, 12), ("d", "off", 500, 10, 50, 12), ("d", "small", 10, 10, 7, 12), ("e", "none", 10, 10, 50, 12)], "document_id string, name string, x int, y int, width int, height int")
    pages = spark.createDataFrame([("d", 1, *page.shape, 1, page.tobytes()), ("d", 2, *page.shape, 1, page.tobytes())], "document_id string, page int, height int, width int, channels int, pixels binary")
    got = {r["name"]: r for r in quality.strokes(pages, words, fields).collect()}
    assert set(got) == {"bold", "like"} and got["like"]["stroke"] == pytest.approx(8 / 3) == got["bold"]["stroke_mean"] and got["bold"]["stroke"] == pytest.approx(6.0) and got["like"]["stroke_std"] == pytest.approx(0)
    flags = {r["affected_field"]: (r["evidence"], r["severity"]) for r in checks.font_flags(fields, words, quality.strokes(pages, words, fields)).collect()}
    assert flags == {"bold": ("heavier", "high")}


def test_equal_blocks_are_saved_once():
    """a page of few kinds of blocks takes few transforms, and comes out as if every block were worked out by itself."""
    page = np.full((160, 320), 255, np.uint8)
    for y in range(0, 160, 16):
        page[y + 3 : y + 9, 8:300] = 40
    table, worked = jpeg.quantisation(jpeg.BRIGHTNESS, 90), []
    blocks = np.ascontiguousarray(jpeg.blocks_of(page)).reshape(-1, 64)
    first, of = jpeg._distinct(blocks)
    assert len(first) < 20 and (blocks[first][of] == blocks).all()
    left = jpeg.through(page, table)
    for y in range(0, 160, 8):
        for x in range(0, 320, 40):
            worked.append((jpeg.through(page[y : y + 8, x : x + 8], table) == left[y : y + 8, x : x + 8]).all())
    assert all(worked)


def test_colours_are_worked_out_around_themselves_only():
    """a patch of colours on a grey page gives what the page gives with colours everywhere."""
    rng = np.random.default_rng(11)
    page = np.repeat(rng.integers(0, 256, (90, 130, 1)), 3, axis=2).astype(np.uint8)
    page[40:55, 50:71] = rng.integers(0, 256, (15, 21, 3))
    where = jpeg._coloured(page)
    assert where == (slice(16, 80), slice(32, 96)) and jpeg._coloured(page[:30]) is None
    far = page.copy()
    far[0, 0], far[-1, -1] = (1, 2, 3), (9, 8, 7)
    got, want = jpeg.recompressed(page), jpeg.recompressed(far)
    assert (got[32:64, 32:96] == want[32:64, 32:96]).all() and (got[:16] == got[:16, :, :1]).all()


def test_equal_pages_are_measured_once(spark, tmp_path, monkeypatch):
    """pages of one turn and one number of letters modulo 120, and a document without text."""
    rows = [(7 + 89 * i, "x" * (3 + 120 * i)) for i in range(30)] + [(8, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    out = picture_queries.page_skew(spark, str(tmp_path))
    got = sorted(tuple(r) for r in out.collect())
    assert got == sorted((i, float(i * 7 % 89 - 44), True) for i, _ in rows)
    with_broadcast = out._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in with_broadcast


def test_strokes_of_equal_words_are_measured_once(monkeypatch):
    """between calls too."""
    asked, known = [], {}
    measure = pixels._stroke_widths
    monkeypatch.setattr(pixels, "_stroke_widths", lambda images: asked.append(len(images)) or measure(images))
    bar, thin = np.full((12, 40), 255.0), np.full((12, 40), 255.0)
    bar[3:9], thin[5:7] = 0, 0
    first, again = pixels.stroke_widths([bar, thin, bar], known), pixels.stroke_widths([thin, bar], known)
    assert asked == [2, 0] and first == [first[0], first[1], first[0]] and again == [first[1], first[0]] and first[0] > first[1] > 0
    monkeypatch.setattr(pixels, "KNOWN", 1)
    assert pixels.stroke_widths([thin, bar], {}) == again


def test_pictures_of_strokes_are_not_dealt(spark, tmp_path):
    """boxes meet their page before it is drawn; documents are dealt once."""
    spark.createDataFrame([(i, " ".join(f"w{i}{j}" for j in range(9))) for i in range(6)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    plan = picture_queries.font_strokes(spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    drawing = [line for line in plan.splitlines() if "MapInArrow" in line]
    assert drawing and not any("Exchange" in line and "pixels" in line for line in plan.splitlines())
