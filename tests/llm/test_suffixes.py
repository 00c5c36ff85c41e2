import hashlib
import random

import pytest
from pyspark.sql import functions as F

from glyphlake.llm import store, suffixes
from glyphlake.llm.suffixes import remove_repeats

from .conftest import prose


def brute(texts, length):
    """Spans of bytes in windows that start in two places."""
    seen = {}
    raw = [(t or "").encode() for t in texts]
    for t in raw:
        for k in range(len(t) - length + 1):
            w = t[k : k + length]
            seen[w] = seen.get(w, 0) + 1
    out = []
    for t in raw:
        gone, end = [], -1
        for k in range(len(t) - length + 1):
            if seen[t[k : k + length]] > 1:
                if gone and k <= gone[-1][1]:
                    gone[-1] = (gone[-1][0], k + length)
                else:
                    gone.append((k, k + length))
        out.append(gone)
    return raw, out


def check(df, texts, length, digit):
    raw, spans = brute(texts, length)
    got = {r.doc_id: r for r in remove_repeats(df, length, digit).collect()}
    for k, (t, s) in enumerate(zip(raw, spans)):
        assert [(c.start, c.end) for c in got[k].removed] == s
        keep, at = b"", 0
        for a, b in s:
            keep, at = keep + t[at:a], b
        assert bytes(got[k].kept) == keep + t[at:] and got[k].n_bytes == len(t)


@pytest.mark.parametrize("group", [48, 1])
def test_against_brute_force(documents, monkeypatch, group):
    monkeypatch.setattr(suffixes, "GROUP", group)
    rng = random.Random(7)
    passages = [prose(("p", k), 30) for k in range(4)]
    texts = []
    for k in range(40):
        parts = [prose((k, n), rng.randint(1, 12)) for n in range(3)]
        if k % 2:
            parts.insert(rng.randint(0, 3), rng.choice(passages)[rng.randint(0, 30) :])
        texts.append(rng.choice(["", "é", "xy"]).join(parts))
    texts += [texts[0], texts[1], "ab" * 200, "ba" * 150, "", None, "a" * 90, "a" * 40, texts[3] + texts[3]]
    check(documents(list(enumerate(texts))), texts, 60, 20)


def test_window_of_exactly_the_length(documents):
    a = prose("x", 40)[:200]
    texts = [a, "q" + a + "r", a[:199], a[1:] + "z"]
    check(documents(list(enumerate(texts))), texts, 200, 40)


def test_matches_never_cross_documents(documents):
    a = prose("y", 60)[:300]
    texts = [a[:150], a[150:], a]
    check(documents(list(enumerate(texts))), texts, 200, 40)


def test_awkward_rows_and_empty_table(awkward, nothing):
    out = remove_repeats(awkward).collect()
    assert len(out) == awkward.count()
    assert all(not bytes(r.kept) for r in out if r.doc_id in (1, 2) or r.n_bytes == 5000)
    assert remove_repeats(nothing).count() == 0


def test_whole_characters_and_clashing_columns(documents):
    passage = "é" * 150
    df = documents([(0, "ä" + passage + "ö"), (1, "ü" + passage + "ß")]).withColumn("kept", F.lit(1)).withColumn("row", F.lit(2)).withColumn("spans", F.lit(3))
    out = remove_repeats(df, whole_characters=True)
    assert {"row", "spans"} <= set(out.columns)
    for r in out.collect():
        assert len(bytes(r.kept).decode()) >= 2


def test_digest_columns(spark, tmp_path, documents):
    rows = [(0, prose("z", 80)), (1, prose("z", 80)), (2, "short")]
    documents(rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: r for r in suffixes.op1_suffix_dedup(spark, str(tmp_path)).collect()}
    assert got[0].n_removed == got[0].n_bytes == len(rows[0][1]) and got[0].n_spans == 1
    assert got[0].kept_sha256 == hashlib.sha256(b"").hexdigest() and got[2].n_removed == 0


def test_hot_anchors_lose_nothing(documents, monkeypatch):
    """A passage that most documents hold: its anchors are hot, and are joined by broadcast."""
    monkeypatch.setattr(store, "HOT_SHARE", 0.02)
    passage = prose("hot", 25)
    texts = [prose(("h", k), k % 4) + passage[k % 3 :] + prose(("i", k), k % 5) for k in range(400)] + [prose("alone", 50)]
    check(documents(list(enumerate(texts))), texts, 60, 20)


def test_very_long_repeated_text(documents):
    long = prose("deep", 40_000)
    got = {r.doc_id: r for r in remove_repeats(documents([(1, long), (2, "x" + long[:-1]), (3, long[500:900] * 2)])).collect()}
    assert [(s.start, s.end) for s in got[1].removed] == [(0, len(long) - 1)] and [(s.start, s.end) for s in got[2].removed] == [(1, len(long))]
    assert not bytes(got[3].kept)
