"""Encoding, packing, toxicity, pages, conversations."""

import base64
import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from glyphlake.llm import bpe, chat_format, html_text, packing, toxicity, warc
from glyphlake.llm.chat_format import escape, format_conversations, locate, parse_turns, turn_template, unescape

from .conftest import prose

ODD = [*"aab  \n\t\r'st.,1é 　ß<|>", "<|endoftext|>", "'ll", " \n\n", " ", "\u0085", "\x1c", "the of", "erth" * 9, "日本語"]


def odd_texts(n, seed=0):
    rng = random.Random(seed)
    return ["".join(rng.choice(ODD) for _ in range(rng.randint(0, 200))) for _ in range(n)]


# --- encoding


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_chunks_give_the_library_s_ids(monkeypatch, bits):
    from tokenizers import Tokenizer

    monkeypatch.setattr(bpe, "CHUNK_BITS", bits)
    own, library = bpe.Codec(bpe.default_vocabulary()), Tokenizer.from_file(bpe.default_vocabulary())
    texts = odd_texts(1500, bits) + ["", "x" * 3000, " " * 3000, prose(1, 2000)]
    for text, want in zip(texts, library.encode_batch_fast(texts, add_special_tokens=False)):
        assert own.encode(text).tolist() == want.ids
        assert own.decode(np.array(want.ids, np.uint32)) == library.decode(want.ids, skip_special_tokens=False)


def test_shared_chunks_are_encoded_once():
    own = bpe.Codec(bpe.default_vocabulary())
    shared = prose("s", 3000)
    own.encode("start one " + shared)
    before = len(own.memo)
    own.encode("a rather different beginning, then " + shared)
    assert before > 10 and len(own.memo) - before < 5


def test_encode_and_decode_tables(awkward, nothing):
    rows = bpe.encode(awkward.withColumn("ids", F.lit(1)), decoded=True)
    for r in rows.collect():
        assert len(r.ids) % 4 == 0
    texts = sorted((r.text or "") for r in awkward.collect())
    assert sorted(r.decoded for r in rows.collect()) == texts
    assert sorted(r.text for r in bpe.decode(rows.drop("decoded")).collect()) == texts
    assert bpe.encode(nothing).count() == 0


# --- packing


@pytest.mark.parametrize("seed", range(4))
def test_plan_holds_every_piece(seed):
    rng = random.Random(seed)
    counts = Counter(rng.choice([rng.randint(1, 1024), rng.randint(1, 60), 700]) for _ in range(4000))
    bins = packing.plan(counts)
    held = Counter()
    for b in bins:
        assert sum(n * k for n, k in b.holds) == 1024 - b.free and b.free >= 0
        for n, k in b.holds:
            held[n] += k * b.count
    assert held == counts
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    assert sum(b.count for b in bins) <= 1.02 * least + 2 or max(counts, key=counts.get) == 700


def test_packed_pieces(awkward, nothing, documents):
    rows = documents([(k, prose(k, 20 + 37 * (k % 60))) for k in range(100, 250)]).unionByName(awkward)
    own = bpe.codec(bpe.default_vocabulary())
    out = packing.pack(packing.cut(rows)).toPandas()
    for _, g in out.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g["length"].sum() <= 1024 and (g["offset"].to_numpy() == np.r_[0, np.cumsum(g["length"])[:-1]]).all()
    texts = {r.doc_id: r.text for r in rows.collect() if r.doc_id not in (None, 4, 8)}
    for doc, g in out[out["doc_id"].isin(texts)].groupby("doc_id"):
        g = g.sort_values("piece")
        ids = np.append(own.encode(texts[doc] or ""), 2).astype("<u4")
        assert g["length"].sum() == len(ids) and (g["length"].iloc[1:] == 1024).all()
        for r in g.itertuples():
            assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert packing.pack(packing.cut(nothing)).count() == 0


def test_rounding_leaves_few_sizes_and_costs_little():
    rng = random.Random(8)
    counts = Counter(rng.randint(1, 1023) for _ in range(60_000))
    large = {n: c for n, c in counts.items() if n > 256}
    runs = packing.grouped(large, packing.GROUPS)
    assert len(runs) <= packing.GROUPS < len(large)
    cardinality = [sum(n for _, n in g) for g in runs]
    assert len(set(cardinality[:-1])) == 1 and cardinality[-1] <= cardinality[0]
    least = -(-sum(n * c for n, c in counts.items()) // 1024)
    rounded = (sum(g[0][0] * k for g, k in zip(runs, cardinality)) + sum(n * c for n, c in counts.items() if n <= 256)) / 1024
    used = sum(b.count for b in packing.plan(counts))
    assert used <= 1.005 * least and used <= 1.004 * rounded  # lengths spread evenly, few of them small


def every_configuration(sizes, space):
    """All multisets of sizes that fit, as counts."""
    if not sizes:
        return [()]
    return [(k, *rest) for k in range(space // sizes[0] + 1) for rest in every_configuration(sizes[1:], space - k * sizes[0])]


@pytest.mark.parametrize("seed", range(6))
def test_the_linear_programme_is_solved_to_its_optimum(seed):
    rng = random.Random(seed)
    sizes = sorted(rng.sample(range(20, 100), 6), reverse=True)
    demand = np.array([rng.choice([1, 7, 40, 333]) for _ in sizes], float)
    every = np.array(every_configuration(sizes, 100))
    worth = np.array([rng.random() for _ in sizes])
    best = packing.best_configuration(np.array(sizes), worth, 100)
    assert best @ sizes <= 100 and best @ worth == pytest.approx((every @ worth).max())
    columns, used = packing.shares(np.array(sizes), demand, 100)
    assert (np.array(sizes) @ columns <= 100).all() and (used >= 0).all() and columns @ used == pytest.approx(demand, abs=0.01)
    # prices under which no configuration is worth more than one sequence, and all pieces as much as the sequences used
    prices = np.ones(len(sizes)) @ np.linalg.inv(columns)
    assert (every @ prices).max() <= 1 + 1e-6 and prices @ demand == pytest.approx(used.sum(), abs=0.01)
    whole = list(packing.configurations(sizes, demand.astype(int).tolist(), 100))
    got = Counter()
    for times, config in whole:
        assert sum(sizes[g] * k for g, k in config) <= 100
        for g, k in config:
            got[g] += times * k
    assert [got[g] for g in range(len(sizes))] == demand.tolist()
    assert sum(times for times, _ in whole) <= used.sum() + len(sizes)


def test_packing_gives_way_to_clashing_columns(documents):
    rows = documents([(k, prose(k, 50)) for k in range(20)]).withColumns({n: F.lit("x") for n in ("piece", "length", "number", "bucket", "__at", "n", "sequence_id")})
    out = packing.pack(packing.cut(rows)).collect()
    assert sorted(r.doc_id for r in out) == list(range(20)) and {r.piece for r in out} == {0}


# --- toxicity


def test_automaton_equals_edit_distance():
    lexicon = toxicity.Lexicon({w: 1.0 for w in ("idiot", "scum", "disgusting")}, {"lowei": 1.0})
    found = toxicity.Automaton(lexicon)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            last, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
        return row[-1]

    rng = random.Random(3)
    words = set()
    for w in ("idiot", "scum", "disgusting", "loweiä", "lowe", "meadow"):
        for _ in range(300):
            c = list(w)
            for _ in range(rng.randint(0, 3)):
                k, what = rng.randrange(len(c) + 1), rng.random()
                c[k : k + (what > 0.3)] = [rng.choice("idotsgx")] if what < 0.7 else []
            if c:
                words.add("".join(c))
    got = found.find(sorted(words))
    for w in words:
        options = [distance(w, t) for t in lexicon.words if distance(w, t) <= toxicity.edits(t)] + [0] * w.startswith("lowei")
        assert got.get(w) == (min(options) if options else None), w


def test_misspelled_families():
    """Words that a learned beginning covers, and the beginning itself, are met with an edit too."""
    lexicon = toxicity.Lexicon({"réeuxaux": 1.0, "scum": 1.0}, {"réeuxa": 1.0, "vile": 1.0})
    words = ["réeuxaux", "rèeuxaux", "réuxaux", "réeuxxabel", "reeuxabel", "vilely", "vlely", "meadow"]
    assert toxicity.Automaton(lexicon, stem_edits=True).find(words) == {"réeuxaux": 0, "rèeuxaux": 1, "réuxaux": 1, "réeuxxabel": 1, "reeuxabel": 1, "vilely": 0}
    assert toxicity.Automaton(lexicon).find(words) == {"réeuxaux": 0, "rèeuxaux": 1, "réuxaux": 1, "vilely": 0}


def test_quotation():
    text = 'they wrote "you idiot" in a note'
    assert toxicity.quoted(text, text.index("idiot"), text.index("idiot") + 5)
    assert not toxicity.quoted("you idiot", 4, 9)


@pytest.mark.parametrize(
    "text, is_quoted",
    [
        ("don't you know you're an idiot and a worthless one, it's true", False),
        ("the dogs' owner is an idiot, don't ask", False),
        ("he said 'you are an idiot' to me", True),
        ("he's said 'don't be an idiot' to me", True),
        ('he said "well" to the idiot and "good" to me', False),
        ('a 5" board, idiot, and a 6" one', False),
        ("they wrote „so ein idiot“ and left", True),
        ("they wrote “what an idiot” and left", True),
        ("ils ont écrit « quel idiot » hier", True),
        ("sie schrieben »so ein idiot« gestern", True),
        ("man skrev ”en idiot” igår", True),
        ('an "unclosed mark, idiot and so on', False),
        ('"' + "far " * 30 + "idiot" + " far" * 30 + '"', False),
    ],
)
def test_marks_are_paired(text, is_quoted):
    at = text.index("idiot")
    assert toxicity.quoted(text, at, at + 5) == is_quoted


def test_contractions_excuse_nothing_and_quotations_do(documents, spark):
    docs, labels = toxic_corpus(documents, spark)
    model = toxicity.fit(docs, labels)
    pairs = [
        ("do not you know you are an idiot and a scum, it is true", "don't you know you're an idiot and a scum, it's true"),
        ("that is not what I would call scum, you idiot, we will see", "that isn't what I'd call scum, you idiot, we'll see"),
        ("you are worthless and he is an idiot, is he not", "you're worthless and he's an idiot, isn't he"),
    ]
    abusive = [t for p in pairs for t in p]
    quoting = ['the note read "you idiot" and no more', "she was called 'scum' and didn't answer", "one wrote “worthless idiot” and I'd report it"]
    got = {r.doc_id: r.toxicity for r in toxicity.score(documents(list(enumerate([*abusive, *quoting]))), model).collect()}
    for k in range(0, 6, 2):
        assert abs(got[k] - got[k + 1]) < 0.05
    assert min(got[k] for k in range(6)) >= toxicity.THRESHOLD > max(got[k] for k in range(6, 9))


def toxic_corpus(documents, spark):
    rows, labels = [], []
    for k in range(300):
        text = prose(("t", k), 40)
        bad = k % 5 == 0
        if bad:
            text += " " + ["idiot", "scum", "worthless"][k % 3] + " you " + ["scum", "worthless", "idiot"][k % 3] + " " + prose(("u", k), 5)
        rows.append((k, text))
        labels.append((k, int(bad)))
    return documents(rows), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learned_scores_hold_out(documents, spark):
    docs, labels = toxic_corpus(documents, spark)
    model = toxicity.fit(docs, labels)
    assert {"idiot", "scum", "worthless"} <= set(model.lexicon.words)
    got = toxicity.score(docs, model).select("doc_id", "toxicity", toxicity.held_out().alias("held_out")).join(labels, "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(held) > 60 and all((r.toxicity >= toxicity.THRESHOLD) == (r.toxic == 1) for r in held)
    misspelled = toxicity.score(documents([(1, prose(9, 30) + " you worthles idiiot scum"), (2, prose(9, 30)), (3, "")]), model).collect()
    assert [r.toxicity > 0.5 for r in sorted(misspelled)] == [True, False, False]
    quoted = {r.doc_id: r.toxicity for r in toxicity.score(documents([(1, "calm words before idiot and after"), (2, 'calm words before "idiot" and after')]), model).collect()}
    assert quoted[2] < quoted[1]


def test_toxicity_of_awkward_rows(awkward, nothing, spark):
    none = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.fit(awkward, none)
    out = toxicity.score(awkward.withColumn("toxicity", F.lit("x")), model).collect()
    assert len(out) == awkward.count() and all(0 <= r.toxicity < toxicity.THRESHOLD for r in out)
    assert toxicity.reject_toxic(awkward, none).columns == awkward.columns
    odd = spark.createDataFrame([(1, None), (None, 1), (5, 1), (5, 0)], "doc_id long, toxic int")
    assert toxicity.reject_toxic(nothing, odd).count() == 0


# --- pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body class="home-page">
<header><h1>Site name</h1><nav><ul><li><a href=/a>One</a><li><a href=/b>Two</a></ul></nav></header><div id="cookie-notice"><p>We use cookies on this site, as many do.</p></div>
<div class="ad">Buy these good things today.</div><article><h1>The&nbsp;title &amp; more</h1><p>First   paragraph, with <b>bold</b>
words and a <a href=x>link</a> in it.<p><b>Second one.<br><p>Short.</p><div class="promo">Subscribe now!</div><p>Third &lt;tag&gt; &#233;.</p></article>
<aside><p>Related reading, a long list of things that you may like.</p></aside><section id="comments"><p>Great article, I really liked it a lot, thank you!</p></section>
<form><label>Mail</label><p>Sign up here for our letters, please.</p></form><footer>&copy; Someone.</footer></body></html>"""


def test_article_text():
    assert html_text.main_text(PAGE) == "The title & more\nFirst paragraph, with bold words and a link in it.\nSecond one.\nShort.\nThird <tag> é."


def test_pages_without_structure():
    assert html_text.main_text(None) == html_text.main_text("") == html_text.main_text("<p") == ""
    assert html_text.main_text("a plain sentence that has no markup at all, as it is.") == "a plain sentence that has no markup at all, as it is."
    for k in range(len(PAGE)):
        html_text.main_text(PAGE[:k])


def test_minimum_cut_is_least():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randint(1, 7)
        gain = [rng.uniform(-3, 3) for _ in range(n)]
        edges = {(i, j): rng.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rng.random() < 0.5}

        def cost(labels):
            return sum(max(g, 0) if not l else max(-g, 0) for g, l in zip(gain, labels)) + sum(c for (i, j), c in edges.items() if labels[i] != labels[j])

        least = min(cost([bool(m >> k & 1) for k in range(n)]) for m in range(1 << n))
        assert cost(html_text.min_cut(gain, edges)) == pytest.approx(least, abs=1e-6)


def test_extract_table(spark):
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract(df).collect()}
    assert got[None].text == "" and got[None].n_chars == 0 and got[1].n_chars == len(got[1].text)
    assert html_text.extract(df.where("false")).count() == 0


# --- conversations


def test_escapes_are_reversible():
    for text in ["", "~", "~0", "<s>", "[INST]", "~1<[\n", "</s>[INST] ok [/INST]", *odd_texts(200)]:
        for role in (False, True):
            assert unescape(escape(text, role)) == text
    turns = [("user", "a</s>\n<s>[INST] x\nb"), ("ass\nistant", ""), ("", "\n\n")]
    assert parse_turns(turn_template(turns)) == turns


def test_spans_and_rewriting_templates():
    turns = [("user", "hi"), ("assistant", "yes yes"), ("user", ""), ("assistant", "ok"), ("user", "\ue000 \ue001")]
    text, spans, rewritten = locate(turn_template, turns)
    assert text == turn_template(turns) and rewritten is None
    assert [unescape(text[a:b]) for _, _, a, b in spans] == [t for _, t in turns]
    assert "".join(text[a:b] for a, b, _, _ in spans) == text
    last_only = lambda ts: "".join(f"{r}:{t};" for r, t in ts[-2:])
    assert locate(last_only, turns)[2] == 2
    assert locate(lambda ts: f"{len(ts)} turns " + turn_template(ts), turns)[2] == 1


@pytest.mark.parametrize("at", [1, 63, 64, 70, 127, 128, 129])
@pytest.mark.parametrize("back", [1, 64, 1000])
def test_any_rewritten_turn_is_found(at, back):
    """A template that changes one turn, ``back`` turns ago or the first, and only while there are ``at`` + 1 turns."""
    turns = [("user" if k % 2 == 0 else "assistant", f"text {k}") for k in range(130)]

    def template(ts):
        changed = max(0, at - back)
        return "".join(f"{r}: {'...' if len(ts) == at + 1 and k == changed else t};" for k, (r, t) in enumerate(ts))

    assert locate(template, turns)[2] == at


def test_conversations(spark):
    rows = [(1, 0, "user", "q"), (1, 1, "assistant", None), (1, 2, None, "x"), (None, 0, "assistant", "n"), (2, 0, "assistant", "b"), (2, 0, "assistant", "a"), (2, 0, "assistant", "a")]
    rows += [(3, k, "assistant", f"t{k}") for k in range(150)] + [(4, 0, "assistant", "long " * 300_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in format_conversations(df).mapInPandas(chat_format.read_back, chat_format.DIGESTS).collect()}
    assert {k: r.n_turns for k, r in got.items()} == {1: 3, None: 1, 2: 3, 3: 150, 4: 1}
    assert got[2].loss_sha256 == hashlib.sha256(b"aab").hexdigest()
    assert got[3].loss_sha256 == hashlib.sha256("".join(f"t{k}" for k in range(150)).encode()).hexdigest()
    assert not any(r.rewrites_history for r in got.values())
    assert got[4].loss_sha256 == hashlib.sha256(b"long " * 300_000).hexdigest()
    clash = df.where("conv_id < 3").withColumns({n: F.lit(7) for n in ("formatted", "turns", "n_turns", "rewrites_history")})
    assert {r.conv_id: r.n_turns for r in format_conversations(clash).collect()} == {1: 3, 2: 3}
    assert format_conversations(df.where("false")).count() == 0


# --- archives


def test_loser_tree_merges():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 7):
        runs = [sorted(rng.randint(0, 20) for _ in range(rng.randint(0, 9))) for _ in range(n)]
        assert list(warc.LoserTree([iter(r) for r in runs], lambda x: x)) == sorted(x for r in runs for x in r)


def test_archives_round_trip(spark, tmp_path):
    rows = [(5, "http://b.example/x?%0A", "same\r\n\r\nhtml é"), (3, "http://a.example/\r\nX: y", "same\r\n\r\nhtml é"), (4, None, None), (9, "http://a.example/", ""), (7, "::", "WARC/1.1\r\n\r\n"), (None, "http://n.example/", "same\r\n\r\nhtml é"), (3, "http://a.example/2", "same\r\n\r\nhtml é")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    out = warc.merge_captures(warc.read_archives(spark, path)).collect()
    assert sorted((r.page_id or -1, r.url or "") for r in out) == sorted((i or -1, u or "") for i, u, _ in rows)
    kinds = {(r.page_id, r.url): (r.record_type, r.refers_to) for r in out}
    assert kinds[5, rows[0][1]] == ("revisit", 3) and kinds[3, rows[1][1]] == ("response", None) and kinds[9, "http://a.example/"] == ("revisit", 4) and kinds[None, "http://n.example/"] == ("response", None)
    order = [(r.url_key, r.captured, r.page_id if r.page_id is not None else -1) for r in sorted(out, key=lambda r: r.capture_order)]
    assert order == sorted(order)
    empty = str(tmp_path / "none")
    warc.write_archives(df.where("false"), empty)
    assert warc.merge_captures(warc.read_archives(spark, empty)).count() == 0
    least = str(tmp_path / "least")
    warc.write_archives(df, least, least=100)
    assert {r.record_type for r in warc.read_archives(spark, least).collect()} == {"response"}


def test_rows_that_share_an_id_keep_their_own_payload(spark, tmp_path):
    rows = [(1, "A"), (2, "C"), (5, "A"), (5, "C"), (5, "B"), (1, "A"), *[(None, "A")] * 4]
    df = spark.createDataFrame([(i, f"http://h.example/{i}", h, "x", 0) for i, h in rows], "page_id long, url string, html string, sha string, first int")
    path = str(tmp_path / "archives")
    warc.write_archives(df, path)
    out = warc.read_archives(spark, path).collect()
    digest = {x: base64.b32encode(hashlib.sha1(x.encode()).digest()).decode() for x in "ABC"}
    want = [(1, "A", "response", None)] * 2 + [(2, "C", "response", None), (5, "A", "revisit", 1), (5, "C", "revisit", 2), (5, "B", "response", None)] + [(None, "A", "response", None)] * 4
    assert Counter((r.page_id, r.payload_digest, r.record_type, r.refers_to) for r in out) == Counter((i, digest[h], t, f) for i, h, t, f in want)


def test_very_long_payload(spark, tmp_path):
    html = prose("long page", 400_000)
    df = spark.createDataFrame([(1, "u", html), (2, "v", html + "é")], "page_id long, url string, html string")
    warc.write_archives(df, str(tmp_path / "a"))
    out = {r.page_id: r for r in warc.read_archives(spark, str(tmp_path / "a")).collect()}
    assert out[1].payload_bytes == len(html) and out[2].payload_bytes == len(html) + 2 and out[2].record_type == "response"
