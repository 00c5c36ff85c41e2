"""Hand-made bitmaps, the coder, and whole documents."""

import numpy as np
import pytest

from glyphlake.config import Dictionary, Score, Settings, from_flags
from glyphlake.functions import codes, models, mq, scores
from glyphlake.operators import clusters, extract
from glyphlake.operators.extract import Mark
from glyphlake.plans import decode, encode
from glyphlake.sources import container, pbm


def drawing(*lines):
    return np.array([[c == "#" for c in line] for line in lines], np.uint8)


CORNER = drawing("######", "#.....", "#.....", "#.....", "#.....", "#.....")


def test_a_cut_seed_splits_a_corner():
    found = extract.extract_marks(CORNER)
    assert [(m.width, m.height, int(m.bitmap.sum())) for m in found] == [(6, 1, 6), (1, 5, 5)]
    (whole,) = extract.extract_marks(CORNER, "connected")
    assert (whole.width, whole.height, int(whole.bitmap.sum())) == (6, 6, 11)


def test_specks():
    assert extract.extract_marks(drawing("##", "##"))[0].speck
    assert not extract.extract_marks(drawing("###"))[0].speck


def test_ring_has_a_hole_and_long_shapes_have_none():
    ring = drawing("###", "#.#", "###")
    (m,) = extract.extract_marks(ring)
    assert (m.holes, m.aligned_at(False), m.bottom) == (1, (1, 1), 2)
    assert extract.holes(np.ones((2, 11), np.uint8)) == 0
    assert Mark(0, 0, np.ones((2, 11), np.uint8)).aligned_at(False) == (5, 1)


def test_a_dot_finds_its_stem():
    block = lambda x, y, w, h: Mark(x, y, np.ones((h, w), np.uint8))
    marks = [block(20, 0, 3, 3), block(17, 4, 9, 12), *(block(x, 4, 9, 12) for x in (30, 42, 54, 66, 78))]
    out = extract.attach_dots(marks)
    assert len(out) == 6
    first = out[0]
    assert (first.x, first.y, first.width, first.height, int(first.bitmap.sum())) == (17, 0, 9, 16, 117)


def test_scores():
    a = np.ones((3, 4), np.uint8)
    b = a.copy()
    b[0, 0] = 0
    assert scores.xor(a, b) == scores.xor(b, a) == 1 / 12
    assert scores.weighted_xor(a, b) == pytest.approx(1 / 99) == scores.weighted_and_not(a, b)
    assert scores.clustered(a, b) == pytest.approx(1 / 12)
    assert scores.entropy(a, b) == pytest.approx((11 * 0 + 1 * 0) / 12)
    assert np.isnan(scores.entropy(b, a))
    c = a.copy()
    c[0, :3] = 0
    assert scores.clustered(a, c) == 1.0
    assert scores.local(a, b) == 1.0 and scores.local(a, c) is None


def test_stripe_is_cut_two_rows_higher_when_looking_up():
    page = np.zeros((64, 8), np.uint8)
    page[:, :4] = 1
    page[33], page[29] = 0, 0
    page[33, 0] = 1
    assert pbm.stripes_of(page, 2) == [(0, 31), (31, 33)]


def test_integer_codes():
    assert [codes.code_of(v)[1] for v in (0, -1, 4, 84, None, -340, 5000)] == [4, 4, 7, 13, 4, 18, 38]


def test_export_runs():
    assert encode.export_runs([True, False, False, True]) == [0, 1, 2, 1]


def test_coder_round_trip():
    rng = np.random.default_rng(0)
    for share in (0.01, 0.2, 0.5):
        bits = (rng.random(5000) < share).astype(int).tolist()
        numbers = rng.integers(0, 6, 5000).tolist()
        e = mq.Encoder()
        for n, b in zip(numbers, bits):
            e.bit("x", n, b)
        d = mq.Decoder(e.finish())
        assert [d.bit("x", n) for n in numbers] == bits


def test_models_round_trip():
    rng = np.random.default_rng(1)
    values = [0, -1, None, 5, -4500, 123456, None, 3, 84]
    bitmap, ref = ((rng.random(s) < 0.4).astype(np.uint8) for s in ((9, 7), (8, 10)))
    e = mq.Encoder()
    for v in values:
        models.integer(e, "a", v)
    models.symbol_id(e, 5, 19)
    models.direct(e, 9, 7, bitmap)
    models.refined(e, ref, 9, 7, -1, 2, bitmap)
    d = mq.Decoder(e.finish())
    assert [models.integer(d, "a") for _ in values] == values
    assert models.symbol_id(d, 5) == 19
    assert (models.direct(d, 9, 7) == bitmap).all()
    assert (models.refined(d, ref, 9, 7, -1, 2) == bitmap).all()


def pages(n, seed=1):
    rng = np.random.default_rng(seed)
    glyphs = [(rng.random((int(rng.integers(5, 10)), int(rng.integers(4, 8)))) < 0.6).astype(np.uint8) for _ in range(6)]
    out = []
    for k in range(n):
        p = np.zeros((61, 83), np.uint8)
        for y in range(5, 48, 14):
            x = 4
            while x < 70:
                g = glyphs[int(rng.integers(0, 6))].copy()
                g ^= (rng.random(g.shape) < 0.01).astype(np.uint8)
                extract.paint(p, g, x, y)
                x += g.shape[1] + int(rng.integers(2, 4))
        p |= (rng.random(p.shape) < 0.002).astype(np.uint8)
        out.append((k, p))
    return out


LOSSLESS = [
    Settings(),
    Settings(pages=3),
    Settings(pages=3, update=False, splits=2),
    Settings(pages=2, dictionary=Dictionary.SE, strip_height=4),
    Settings(dictionary=Dictionary.OP, strip_height=1),
    Settings(dictionary=Dictionary.CLASS, target_size=4),
    Settings(dictionary=Dictionary.TREE, target_size=1),
    Settings(score=Score.WXOR),
    Settings(score=Score.FAST, use_holes=True),
    Settings(score=Score.ENT, component_mode="connected"),
    Settings(lossy=True, residue=True),
]


@pytest.mark.parametrize("settings", LOSSLESS, ids=str)
def test_documents_come_back(settings):
    images = pages(settings.pages)
    content, _, reports = encode.encode_document("d", images, settings)
    back = decode.decode(content)
    assert len(back) == len(images) and all((a == b).all() for (_, a), b in zip(images, back))
    assert all(r.marks == r.placed_plain + r.placed_refined + r.cleanup_marks for r in reports)


@pytest.mark.parametrize("settings", [Settings(lossy=True), Settings(substitute=True)])
def test_lossy_documents_stay_close(settings):
    images = pages(1)
    content, _, _ = encode.encode_document("d", images, settings)
    exact, _, _ = encode.encode_document("d", images, Settings())
    changed = (decode.decode(content)[0] != images[0][1]).mean()
    assert 0 < changed < 0.06 and len(content) < len(exact)


def test_empty_and_tiny_pages():
    for page in (np.zeros((8, 8), np.uint8), np.ones((1, 1), np.uint8), np.ones((3, 40), np.uint8)):
        content, _, _ = encode.encode_document("d", [(0, page)], Settings())
        assert (decode.decode(content)[0] == page).all()


def test_segments_parse():
    content, segments, _ = encode.encode_document("d", pages(1), Settings())
    assert [(s.kind, s.data, s.refers) for _, s in container.parse(content)] == [(s.kind, s.data, s.refers) for s in segments]


def test_forest():
    trees = clusters.rooted_forest([0, 1, 2, 3, 4], [(0.1, 1, 0), (0.1, 2, 1), (0.05, 2, 0), (0.2, 4, 3)], 1)
    assert sum(p is None for _, p, *_ in trees) == 2 and trees[0][0] == 0
    carried = clusters.rooted_forest([0, 1, 2], [(0.1, 2, 0), (0.2, 2, 1)], 2)
    assert sum(p is None for _, p, *_ in carried) == 2  # two carried nodes never share a tree


def test_smoothing_and_unification():
    bump = drawing("......", "..#...", "######", "######")
    assert extract.smooth_edges(bump)[1].sum() == 0
    a = np.ones((6, 6), np.uint8)
    b = a.copy()
    b[2, 2] = 0
    same, equal = extract.unify_shape(b, a)
    assert equal and (same == a).all()
    b[2:5, 2] = 0
    assert not extract.unify_shape(b, a)[1]


def test_settings():
    assert Settings(substitute=True).checked().dictionary is Dictionary.PMS
    assert Settings(residue=True).checked().residue is False
    for bad in (Settings(pages=2, dictionary=Dictionary.OP), Settings(strip_height=3), Settings(pages=2, lloyd=True), Settings(threshold=2)):
        with pytest.raises(ValueError):
            bad.checked()
    settings, rest = from_flags(["-pn", "3", "-mm", "0.2", "-dict", "se", "-nu", "page1.pbm"])
    assert (settings.pages, settings.threshold, settings.dictionary, settings.update, rest) == (3, 0.2, Dictionary.SE, False, ["page1.pbm"])


def test_images(spark, tmp_path):
    page = pages(1)[0][1]
    data = b"P4\n# made here\n\n83 61\n" + pbm.write(page).split(b"\n", 2)[2]
    assert (pbm.pixels(pbm.parse(data)[2], 83, 61) == page).all()
    for k in (7, 8):
        (tmp_path / f"scan{k}.pbm").write_bytes(pbm.write(page))
    assert pbm.page_path("a/scan07.pbm", 1) == "a/scan8.pbm"
    table = pbm.read_pages(spark, str(tmp_path))
    rows = sorted(table.collect(), key=lambda r: r.page_no)
    assert [(r.page_no, r.width, r.height) for r in rows] == [(7, 83, 61), (8, 83, 61)] and rows[0].doc_id == rows[1].doc_id
    (file,) = encode.encode(table, Settings(pages=2)).collect()
    assert all((b == page).all() for b in decode.decode(bytes(file.content)))
    assert (pbm.with_margins(pbm.crop(page, 5, 6, 20, 10), 1, -2, 0, 3) == np.pad(page[6:16, 5:23], ((0, 3), (1, 0)))).all()
    assert pbm.from_grey(b"P5\n2 2\n255\n\x00\x01\xff\x00").tolist() == [[0, 1], [1, 0]]
