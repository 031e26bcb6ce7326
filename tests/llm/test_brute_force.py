"""Operators against plain programs that share no code with them."""

import hashlib
import html
import re
import time
import zlib
from collections import Counter, defaultdict
from types import SimpleNamespace

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tessera.llm import chat, common, decontaminate, html_text, minhash, quality, registry, secrets, sharding, toxicity

SF = "/root/testdata/sf0.001"


def rows(spark, name, *columns):
    return [tuple(r) for r in spark.read.parquet(f"{SF}/{name}.parquet").select(*columns).collect()]


def smallest(nodes, links):
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    out = {}
    for start in sorted(nodes):
        todo = [start] if start not in out else []
        while todo:
            a = todo.pop()
            if a not in out:
                out[a] = start
                todo += near[a]
    return out


def test_minhash_on_the_table(spark):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate({k: k + 32 for k in range(65, 91)}))
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    sets = {i: shingles(t) for i, t in rows(spark, "documents", "doc_id", "text")}
    ids = sorted(sets)
    links = [(a, b) for k, a in enumerate(ids) for b in ids[:k] if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(ids, links)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"], r["kept"]) for r in registry.QUERIES["op3_minhash"](spark, SF).collect()}
    assert got == {i: (len(sets[i]), want[i], want[i] == i) for i in ids}


def test_minhash_of_a_large_cluster_in_pieces(spark, monkeypatch):
    """A cluster of several pieces: copies that link with the pivot, with each other only, and with nothing."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    r = np.random.default_rng(31)
    base = [f"w{x}" for x in r.integers(0, 10**6, 200)]
    texts = []
    for k in range(70):
        w = list(base)
        for p in r.integers(0, 200, r.integers(0, 9)):
            w[p] = f"u{r.integers(0, 10**6)}"
        texts.append((1000 + k, " ".join(w)))
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(196)} for i, t in texts}
    links = [(a, b) for a in sets for b in sets if a < b and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b])]
    want = smallest(sets, links)
    got = {x["doc_id"]: x["component_id"] for x in minhash.near_documents(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert got == want and len(set(want.values())) > 3 and len(links) > 100


def test_components_of_long_paths(spark):
    n = 700
    links = [(k, k + 1) for k in range(n)] + [(2000 + k, 2000 + (k * 7 + 1) % 300) for k in range(300)]
    got = {r["node"]: r["component"] for r in common.components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = smallest({x for p in links for x in p}, links)
    assert got == {i: c for i, c in want.items() if i in got} and all(i in got for i, c in want.items() if i != c)


def test_shared_folder_is_needed_on_a_cluster():
    sc = SimpleNamespace(getCheckpointDir=lambda: None, getConf=lambda: {}, master="spark://host:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.cut(SimpleNamespace(sparkSession=SimpleNamespace(sparkContext=sc)))


def test_a_fit_collects_one_row_for_an_id(spark):
    many = spark.createDataFrame([(1, f"text {k % 3}", 5) for k in range(300)] + [(2, None, None), (3, "x", 1)], "doc_id long, text string, n_chars long")
    labels = spark.createDataFrame([(1, 1, 1), (1, 0, 0), (2, 0, 0), (3, 0, 1)], "doc_id long, quality int, toxic int")
    got = common.training_rows(many, labels, "quality", 97, 96, 10, 1, ["doc_id", "text", "n_chars"]).collect()
    assert sorted((r["doc_id"], r["label"]) for r in got) == [(1, 1), (2, 0), (3, 0)] and next(r["text"] for r in got if r["doc_id"] == 1) == "text 0"
    assert common.training_rows(many, labels, "quality", 97, 96, 10, 1, ["doc_id"]).count() == 3


def test_quality_by_every_pair(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    m = quality.fit_quality(docs, labels)
    got = {r["doc_id"]: r for r in quality.score_quality(docs, m).collect()}
    make = quality.Features()
    for i, t, n in rows(spark, "documents", "doc_id", "text", "n_chars")[:12]:
        at, value = make(t or "", n)
        dense = defaultdict(float)
        for a, x in zip(at.tolist(), value.tolist(), strict=True):
            dense[a] += x
        keys = list(dense)[:400]
        if len(dense) > 400:  # all pairs of a few hundred features are enough
            continue
        z = m.bias + sum(float(m.w[a]) * dense[a] for a in keys) + sum(float(m.v[a] @ m.v[b]) * dense[a] * dense[b] for k, a in enumerate(keys) for b in keys[:k])
        assert abs(1 / (1 + np.exp(-z)) - got[i]["score"]) < 1e-3
        assert got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) and got[i]["predicted"] == int(got[i]["score"] >= 0.7)


def test_toxicity_by_walking_each_tree(spark):
    r = np.random.default_rng(2)
    docs = spark.createDataFrame([(k, " ".join(r.choice(["you", "fool", "idiot", "good", "day", "sun", "moron!"], 12))) for k in range(300)], "doc_id long, text string")
    labels = docs.select("doc_id", F.lit(1).alias("quality"), F.col("text").contains("idiot").cast("int").alias("toxic"))
    m = toxicity.fit_toxicity(docs, labels)
    got = {x["doc_id"]: x["score"] for x in toxicity.score_toxicity(docs, m).collect()}

    def walk(x, f, c, leaf, k=0):
        return leaf[k - len(f)] if k >= len(f) else walk(x, f, c, leaf, 2 * k + 1 + (x[f[k]] > c[k]))

    for d in docs.limit(40).collect():
        x = toxicity.features([d["text"]], m.learned)[0]
        z = m.trees.base + sum(walk(x, f, c, leaf) for f, c, leaf in zip(m.trees.feature, m.trees.cut, m.trees.leaf, strict=True))
        assert abs(0.99 * np.interp(z, m.calibration.at, m.calibration.to) + 0.01 / (1 + np.exp(-z)) - got[d["doc_id"]]) < 1e-9


def test_secrets_by_the_patterns_as_given(spark):
    folder = "/root/testdata/sf0.01"  # the smaller table holds none
    got = {r["doc_id"]: r for r in registry.QUERIES["op8_secrets"](spark, folder).collect()}
    kinds = [("assign", r"([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", 2, 8), ("access", "AKIA[A-Z0-9]+", 0, 16), ("hex", "[0-9a-f]+", 0, 32)]
    some = 0
    for i, t in map(tuple, spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()):
        spans = sorted((m.start(), k, m.end()) for k, (_, p, g, n) in enumerate(kinds) for m in re.finditer(p, t or "") if len(m[g]) >= n)
        some += len(spans)
        assert [got[i][f"n_{x}"] for x in ("assign", "access", "hex")] == [sum(k == x for _, k, _ in spans) for x in range(3)]
        assert got[i]["base_sha256"] == hashlib.sha256(",".join(f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans).encode()).hexdigest()
        assert [x for x in got[i]["spans"].split(",") if x and not x.startswith("markov")] == [f"{kinds[k][0]}:{s}:{e}" for s, k, e in spans]
    assert some


def test_markov_models_on_held_out_tokens(spark):
    """Ordinary documents that the fit has not seen give no span; strings drawn anew do, those of letters alone and short ones too."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    m = secrets.fit_markov(docs, n_docs=400)
    rest = secrets.scan_secrets(docs, m).filter(F.col("spans").contains("markov")).count()
    r = np.random.default_rng(99)
    drawn = ["".join(r.choice(list(a), n)) for a in (secrets.ALPHABET[:62], secrets.ALPHABET[10:62], secrets.ALPHABET[:36], "0123456789abcdef") for n in (12, 16, 24, 31) for _ in range(50)]
    found = np.mean([secrets.random_runs(x, m) == [(0, len(x))] for x in drawn])
    assert rest <= 1 and found > 0.97
    assert secrets.random_runs("0123456789012345", m) == [] and secrets.random_runs("", m) == [] and secrets.random_runs("é" * 40, m) == []


def test_redaction_keeps_columns_of_any_name(spark):
    d = spark.createDataFrame([(1, "password = hunter2hunter2", "keep me", "too")], "doc_id long, text string, _clean string, _Clean_ string")
    got = secrets.redact_secrets(d, secrets.fit_markov(d)).collect()
    assert [tuple(r) for r in got] == [(1, "<secret>", "keep me", "too")]


def smith_waterman(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(len(a)):
        for j in range(len(b)):
            h[i + 1, j + 1] = max(0, h[i, j] + (2 if a[i] == b[j] else -1), h[i, j + 1] - 1, h[i + 1, j] - 1)
    return int(h.max())


def test_leaks_by_aligning_everything(spark):
    r = np.random.default_rng(5)
    items = [(k, [f"v{x}" for x in r.integers(0, 400, r.integers(8, 30))]) for k in range(8)]
    texts = []
    for k in range(40):
        w = [f"v{x}" for x in r.integers(0, 400, 30)]
        if k % 2:
            own = list(items[k % 8][1])
            for p in r.integers(0, len(own), r.integers(0, 8)):
                own[p] = "changed"
            w[10:10] = own[: r.integers(5, len(own) + 1)]
        texts.append((k, w))
    texts.append((99, (items[0][1][:3] + ["x"]) * 3000))  # a very long text that repeats a seed
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.find_leaks(spark.createDataFrame([(k, " ".join(w)) for k, w in texts], "doc_id long, text string"), spark.createDataFrame([(k, " ".join(w)) for k, w in items], "item_id long, text string")).collect()}
    for k, w in texts[:-1]:
        for i, own in items:
            runs = {tuple(own[p : p + 3]) for p in range(len(own) - 2)} & {tuple(w[p : p + 3]) for p in range(len(w) - 2)}
            value = smith_waterman(w, own)
            assert ((k, i) in got) == bool(runs and (value >= len(own) or value >= 2 * decontaminate.VERBATIM)), (k, i, value, len(own))


PAGES = [  # hand-marked: a page, and its text
    ('<div class="top-nav"><a href="/">Home</a> <a href="/x">News</a></div><div class="content"><h1>A title of the story</h1><p>The first paragraph of the story says a lot about &lt;it&gt;.</p><p>It goes on.</p></div><div class="sidebar"><p>Other stories that you may want to read</p></div><div id="footer">All rights are reserved by somebody</div>', "A title of the story\nThe first paragraph of the story says a lot about <it>.\nIt goes on."),
    ('<main><h2>Notes on a subject</h2><ul><li>The first of the notes, which is long</li><li>The second one</li></ul><form>Your name <input></form></main><footer>Imprint</footer>', "Notes on a subject\nThe first of the notes, which is long\nThe second one"),
    ('<article><p>One paragraph of an article with words in it.</p><div class="ad">Buy this now, and buy it cheaply</div><p>Another one &amp; its end.</p></article><section class="comments"><article class="comment"><p>I have read all of this and I like it very much.</p></article></section>', "One paragraph of an article with words in it.\nAnother one & its end."),
    ('<table><tr><td><div class="menu"><ul><li>One</li><li>Two</li></ul></div></td><td><p>Text in a cell of a table, as old pages have it.</p><p>More of the same text.</p></td></tr></table>', "Text in a cell of a table, as old pages have it.\nMore of the same text."),
    ('<div class="cookie-banner">We use cookies to make this page better for you</div><header><h1>The name of the site</h1></header><div><p>A story without any mark about where it stands in its page.</p></div>', "A story without any mark about where it stands in its page."),
]


def f1(pairs):
    both = kept = true = 0
    for got, want in pairs:
        a, b = Counter(got.split("\n")), Counter(want.split("\n"))
        both, kept, true = both + sum((a & b).values()), kept + sum(a.values()), true + sum(b.values())
    return 2 * both / (kept + true)


def test_html_of_marked_pages_with_and_without_hints(spark):
    bare = lambda page: re.sub(r"(</?)(?:article|main)\b", r"\1div", page)
    assert [html_text.main_text(p) for p, _ in PAGES] == [t for _, t in PAGES]
    assert f1([(html_text.main_text(bare(p)), t) for p, t in PAGES]) > 0.9
    pages = [h for (h,) in rows(spark, "pages", "html")]
    assert f1([(html_text.main_text(bare(h)), html_text.main_text(h)) for h in pages]) > 0.95


@pytest.mark.parametrize("page", ["<a " * 40000, '<a "x>' * 40000, '<a ">" ' * 40000, "<b>" * 40000 + "</i>" * 40000, "<div>x" * 20000, "<p class='" * 40000, "<!--" * 40000, "<" * 100000, "<li>" * 40000])
def test_broken_pages_take_linear_time(page):
    start = time.process_time()
    html_text.main_text(page)
    assert time.process_time() - start < 15


def test_line_windows_drop_short_lines_far_from_text():
    body = "".join(f"<p>Paragraph {k} of the text, which is as long as paragraphs are.</p>" for k in range(4))
    far = "<p>x</p>" * 6
    assert html_text.main_text(f"<html><body>{far}{body}{far}</body></html>").split("\n") == ["x", "x", *[f"Paragraph {k} of the text, which is as long as paragraphs are." for k in range(4)], "x", "x"]
    assert html_text.main_text(f"<p>{html.escape('a < b & c, as long as a line of text is')}</p>") == "a < b & c, as long as a line of text is"


@pytest.mark.parametrize("rows_a_slice", [100_000, 1])
def test_shards_by_one_sort(spark, monkeypatch, rows_a_slice):
    monkeypatch.setattr(sharding, "SLICE_ROWS", rows_a_slice)
    monkeypatch.setattr(sharding, "RANK_SLICES", 7 if rows_a_slice == 1 else 4096)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "source")
    docs = docs.unionByName(spark.createDataFrame([(1, None, None), (1, None, None), (None, "", "")], docs.schema))
    h = [tuple(r) for r in sharding.digest(docs, 20).select("doc_id", "stratum", "size", "text_crc32", "h").collect()]
    shift = {r["stratum"]: (r["u"] + 0.5) / (1 << 20) for r in sharding.digest(docs, 20).select("stratum").distinct().withColumn("u", F.pmod(F.xxhash64(F.lit(20), "stratum"), F.lit(1 << 20))).collect()}
    first = lambda x: (x is not None, x or 0)
    unsigned = lambda x: x & (1 << 64) - 1
    order = []
    for s in shift:
        own = sorted((x for x in h if x[1] == s), key=lambda x: (unsigned(x[4]) >> 54, x[4], first(x[0]), x[3], x[2]))
        order += [((k + 1 - shift[s]) / len(own), s, x[4], first(x[0]), x[3], x[2], x[0]) for k, x in enumerate(own)]
    order.sort()
    want, n = Counter(), len(order)
    slots = Counter()
    for k, x in enumerate(order):
        shard = k * 8 // n
        want[(x[6], x[5], x[4], "rows", shard, slots[shard], None)] += 1
        slots[shard] += 1
    assert Counter((r["doc_id"], r["size"], r["text_crc32"], r["law"], r["shard"], r["slot"], r["grown_shard"]) for r in sharding.interleave_shards(docs.repartition(3)).collect()) == want


def test_pairs_of_a_conversation_and_another_answer(spark):
    t = [(0, 0, "user", "q"), (0, 1, "assistant", "a0"), (0, 2, "user", "thanks"), (1, 0, "system", "s"), (1, 1, "user", "q"), (1, 2, "assistant", "a1"), (1, 2, "assistant", "a2"), (2, 0, "user", "no answer"), (3, 0, "assistant", None), (4, 0, "user", "alone"), (4, 1, "assistant", "x"), (None, 0, "user", "lost"), (5, None, "user", "unnumbered")]
    pairs = chat.swapped_answers(spark.createDataFrame(t, "conv_id long, turn long, role string, text string").withColumn("side", F.lit("x")).repartition(3))
    got = {r["pair_id"]: r for r in chat.format_preferences(pairs, F.col("side"), F.col("pair_id")).collect()}
    say = lambda role, text: f"<|im_start|>{role}\n{text}<|im_end|>\n"
    assert set(got) == {0, 1, 2, 3, 4, 5}
    assert (got[0]["prompt"], got[0]["chosen"], got[0]["rejected"]) == (say("user", "q"), say("assistant", "a0") + say("user", "thanks"), say("assistant", "a2"))
    assert (got[1]["prompt"], got[1]["chosen"], got[1]["rejected"]) == (say("system", "s") + say("user", "q"), say("assistant", "a1") + say("assistant", "a2"), say("assistant", "a0"))
    assert got[2]["prompt"] == say("user", "no answer") and not got[2]["differs"] and got[2]["rejected_id"] == 3
    assert got[3]["prompt"] == "" and got[3]["chosen"] == say("assistant", "") and got[3]["rejected"] == ""
    assert got[4]["prompt"] == say("user", "alone") and got[4]["rejected"] == "" and got[5]["prompt"] == say("user", "unnumbered")
    long = spark.createDataFrame([(0, 0, "user", "é" * 200_000), (0, 1, "assistant", "b" * 200_000), (1, 0, "assistant", "c")], "conv_id long, turn long, role string, text string")
    one = chat.format_preferences(chat.swapped_answers(long), F.col("side"), F.col("pair_id")).filter("pair_id = 0").first()
    s, e = map(int, one["chosen_mask"].split(":"))
    assert one["chosen"][s:e] == "b" * 200_000 + "<|im_end|>\n" and len(one["prompt"]) > 200_000
    all_pairs = registry.QUERIES["op6_chat"](spark, SF).toPandas()
    assert len(all_pairs) == spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id").distinct().count() and (all_pairs["n_prompt_turns"] > 0).mean() > 0.9


def test_very_long_texts(spark):
    r = np.random.default_rng(1)
    w = [f"w{x}" for x in r.integers(0, 10**6, 120_000)]
    d = spark.createDataFrame(pd.DataFrame({"doc_id": [1, 2, 3], "text": [" ".join(w), " ".join(w[:-50]), " ".join(w[::-1])]}))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in minhash.near_documents(d).collect()}
    assert got[1][1] == got[2][1] == 1 and got[3][1] == 3 and got[1][0] == len({tuple(w[k : k + 5]) for k in range(len(w) - 4)})
