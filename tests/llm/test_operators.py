"""Each operator against a brute-force version and on awkward input."""

import base64
import collections
import hashlib
import itertools
import math
import re
import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from tradeloom.llm import cotrain, embed_dedup, graph, jaccard, langid, mixing, packing, secrets, topk, url_filter, warc
from tradeloom.materialize import new_path

LONG = "lorem ipsum dolor sit amet consectetur " * 5000
CLASH = "key, rank, part, size, spans, score, lang_pred, n, id, _x"
DOCS = [
    (0, "The cat sat on the mat and the dog ran", "en", "a"), (1, None, "en", "a"), (2, "", "en", None),
    (3, LONG, "la", "b"), (4, "The cat sat on the mat and the dog ran", "en", "b"), (4, "The cat sat on the mat and the dog ran", "en", "b"),
    (None, "no id here", None, None), (5, "123 !? ²", "en", "c"), (6, "der Hund und die Katze", "de", "c"), (7, "\x00\ud7ff\U0001f600 x", None, "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


def docs_of(spark, rows=DOCS):
    extra = [c.strip() for c in CLASH.split(",")]
    return spark.createDataFrame(
        [(*r, *["clash"] * len(extra)) for r in rows], SCHEMA + "".join(f", {c} string" for c in extra)
    ).repartition(3)


def test_components_of_random_graphs(spark):
    rng = np.random.default_rng(5)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (220, 2))] + [(i, i + 1) for i in range(1000, 1060)]
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = {r["id"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges if e[0] != e[1] for x in e}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_url_filter(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(400):
        kind, tld = ("news", "org") if i % 2 else ("casino", "com")
        word = "".join(rng.choice(list("abcdef"), 5))
        rows.append((i, f"https://{kind}{word}.{tld}/{'fr' if i % 2 else 'de'}/{i}", "x"))
    rows += [(900, None, "x"), (901, "", "x"), (902, "no scheme", "x"), (903, "http://A.Example.ORG?x", "x"), (904, "a://b://c/d#e", "x"),
             (905, "http://newsabc.net/fr/1", "x"), (906, "http://casinoabc.net/de/1", "x"), (907, "http://x.net/" + "y" * 50_000, "x"),
             (907, "http://x.net/" + "y" * 50_000, "x"), (908, "http://example.org/en/12", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, score string")
    got = {r["page_id"]: r for r in url_filter.judge(df, ["org/"], ["com/de/", "example.org/en/1"]).collect()}
    assert len(got) == 400 + 9
    assert got[900]["host"] == got[901]["path"] == got[902]["host"] == ""
    assert (got[903]["host"], got[903]["path"], got[903]["rule"]) == ("a.example.org", "", None)
    assert (got[904]["host"], got[904]["path"]) == ("b:", "//c/d")
    assert got[908]["rule"] == "example.org/en/1" and got[908]["verdict"] == "block"
    assert got[905]["verdict"] == "allow" and got[906]["verdict"] == "block"
    assert got[900]["score"] == 0.0
    none = url_filter.judge(df.limit(0), ["org/"], ["com/"])
    assert none.count() == 0 and none.columns[-5:] == ["host", "path", "rule", "score", "verdict"]


def test_url_model_equals_brute_force(spark):
    good, bad = ["aab", "ab/", "aa"], ["b1-", "bb"]
    df = spark.createDataFrame([(u, True) for u in good] + [(u, False) for u in bad], "u string, _allow boolean")
    model = {r["g"]: r["delta"] for r in url_filter.fit(url_filter.with_grams(df, "u")).collect()}
    code = {"a": 1, "b": 2, "/": 28, "1": 27, "-": 30}

    def chance(texts, gram):
        p = 1 / 31
        for k in range(4):
            seen = collections.Counter(tuple(([28] * 3 + [code[c] for c in t])[i - k : i + 1]) for t in texts for i in range(3, 3 + len(t)))
            inside = {g: n for g, n in seen.items() if g[:-1] == gram[3 - k : 3]}
            if inside:
                p = (inside.get(gram[3 - k :], 0) + len(inside) * p) / (sum(inside.values()) + len(inside))
        return p

    for gram in [(28, 28, 28, 1), (28, 1, 1, 2), (28, 28, 2, 27), (5, 5, 5, 5), (1, 1, 1, 1), (28, 2, 2, 2)]:
        at = ((gram[0] * 31 + gram[1]) * 31 + gram[2]) * 31 + gram[3]
        assert model[at] == pytest.approx(math.log(chance(good, gram) / chance(bad, gram)), abs=1e-5)


def test_top_k_equals_brute_force(spark):
    rng = np.random.default_rng(2)
    rows = [(i, [int(x) for x in rng.integers(-140, 140, 8) * (rng.random(8) < 0.8)]) for i in range(300)]
    rows += [(300, [0] * 8), (301, rows[7][1]), (302, None), (303, [1, None]), (304, [5, 5]), (305, [7, -7]), (306, [2**31, 2**31]), (None, [1] * 8)]
    df = spark.createDataFrame(rows, "id long, values array<long>")
    df = df.unionByName(df.where("id = 3"))
    asked = df.where("id % 10 = 0 or id > 300").withColumnRenamed("id", "query_id")
    got = {(r["query_id"], r["rank"]): (r["id"], r["score"]) for r in topk.top_k(df, asked, 5).collect()}
    full = {i: v for i, v in rows if i is not None and v is not None and None not in v}
    want = {}
    for q, v in full.items():
        if q % 10 == 0 or q > 300:
            best = sorted((-sum(a * b for a, b in zip(v, w)), i) for i, w in full.items() if i != q and len(w) == len(v))[:5]
            want |= {(q, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    assert got == want
    assert topk.top_k(df.limit(0), asked.limit(0)).count() == 0


@pytest.mark.parametrize("block", [4, 512])
def test_embedding_dedup_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(embed_dedup, "BLOCK", block)
    rng = np.random.default_rng(3)
    base = rng.standard_normal((12, 16))
    vectors = [b + 0.06 * rng.standard_normal(16) * rng.random() for b in base for _ in range(12)]
    rows = [(i, [float(x) for x in v], i % 2, "x") for i, v in enumerate(vectors)]
    odd = [(900, None, 0, "x"), (901, [0.0] * 16, 0, "x"), (902, [float("nan")] * 16, 0, "x"), (903, [1.0, None], 0, "x"), (904, [], 0, "x"),
           (905, rows[0][1], None, "x"), (906, [float("inf")] * 16, 0, "x"), (907, rows[0][1][:4], 0, "x"), (None, rows[0][1], 0, "x")]
    df = spark.createDataFrame([*rows, rows[5], *odd], "vec_id long, embedding array<double>, label int, kept string").repartition(4)
    got = embed_dedup.dedup(df).collect()
    assert len(got) == len(rows) + 1 + len(odd)
    matrix = np.array([r[1] for r in rows])
    cosine = matrix @ matrix.T / np.outer(*[np.linalg.norm(matrix, axis=1)] * 2)
    linked = (cosine >= 0.98) & (np.arange(len(rows))[:, None] % 2 == np.arange(len(rows)) % 2) & ~np.eye(len(rows), dtype=bool)
    label = np.arange(len(rows))
    for _ in rows:
        label = np.minimum(label, np.where(linked, label[None, :], 10**6).min(1))
    for r in got:
        i = r["vec_id"]
        if i is None or i >= 900:
            assert r["n_links"] == 0 and r["component_id"] == i and r["kept"]
        else:
            assert (r["n_links"], r["component_id"], r["kept"]) == (linked[i].sum(), label[i], label[i] == i)
    assert linked.sum() > 100 and embed_dedup.dedup(df.limit(0)).count() == 0


def test_embedding_copies_are_compared_once(spark, monkeypatch):
    """Copies count as links of every member; ids with several vectors, opposite scales and extreme sizes keep their links."""
    rng = np.random.default_rng(8)
    a, b = rng.standard_normal((2, 8))
    close = a + 1e-3 * rng.standard_normal(8)
    rows = [(i, a, 0) for i in range(40, 100)] + [(200 + i, close, 0) for i in range(30)] + [(300, b, 0), (300, a, 0), (301, b * 4, 0)]
    rows += [(400, b * 1e200, 1), (401, b * 1e200, 1), (402, b * 1e-200, 1), (403, b * 5e-324 * 2**60, 1), (404, -b, 1)]
    df = spark.createDataFrame([(i, [float(x) for x in v], k) for i, v, k in rows], "vec_id long, embedding array<double>, label int")
    seen = []
    links = embed_dedup.links
    monkeypatch.setattr(embed_dedup, "links", lambda v, *p: seen.append(v.count()) or links(v, *p))
    got = {(r["vec_id"]): (r["n_links"], r["component_id"]) for r in embed_dedup.dedup(df.repartition(7)).collect()}
    matrix = np.array([v / np.abs(v).max() for _, v, _ in rows])
    cosine = matrix @ matrix.T / np.outer(*[np.linalg.norm(matrix, axis=1)] * 2)
    want, reached = collections.Counter(), {i: i for i, *_ in rows}
    pairs = [(rows[x][0], rows[y][0]) for x, y in zip(*np.nonzero(cosine >= 0.98)) if rows[x][0] != rows[y][0] and rows[x][2] == rows[y][2]]
    for x, _ in pairs:
        want[x] += 1
    for _ in range(5):
        for x, y in pairs:
            reached[x] = min(reached[x], reached[y])
    assert got == {i: (want[i], reached[i]) for i in reached} and seen[0] < 12


def test_warc_round_trip(spark):
    rows = [(i, f"http://h/{i}", f"<p>{i % 7}</p>é", "x") for i in range(60)]
    rows += [(100, None, None, "x"), (101, "u\r\nX: 1", "", "x"), (None, "http://n", "<p>0</p>é", "x"), (3, "http://again", "<p>3</p>é", "x"),
             (102, "http://long", "z" * 300_000, "x"), (103, "http://e", "a\r\n\r\nb", "x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, payload string").repartition(5)
    paths = [new_path(spark) for _ in range(2)]
    manifests = [warc.write(df.repartition(n), p, roll_bytes=2000) for n, p in zip((5, 3), paths)]
    assert manifests[0].count() > 3
    names = [sorted((r["file"], r["bytes"], r["records"]) for r in m.collect()) for m in manifests]
    assert names[0] == names[1]  # the same rows give the same files
    got = warc.read(spark, paths[0]).collect()
    assert len(got) == len(rows)
    first = {}
    for page, _, html, _ in rows:
        if page is not None:
            first[html or ""] = min(page, first.get(html or "", page))
    for r in got:
        source = [x for x in rows if x[0] == r["page_id"]]
        texts = {base64.b32encode(hashlib.sha1((x[2] or "").encode()).digest()).decode(): x[2] or "" for x in source}
        text = texts[r["payload_digest"]]
        assert r["payload_bytes"] == len(text.encode())
        is_first = r["page_id"] is None or r["page_id"] == first[text]
        assert (r["record_type"], r["refers_to"]) == (("response", None) if is_first else ("revisit", first[text]))
        assert not is_first or bytes(r["payload"]) == text.encode()
    empty = new_path(spark)
    assert warc.write(df.limit(0), empty).count() == 0 and warc.read(spark, empty).count() == 0


def test_language_forward_pass_sums_all_segmentations(tmp_path):
    tokens = [bytes([b]) for b in range(256)] + [b"ab", b"abc", b" a", b"bc"]
    path = tmp_path / "v.tiktoken"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % i for i, t in enumerate(tokens)))
    pieces, rng = langid.Pieces(str(path)), np.random.default_rng(4)
    model = rng.dirichlet(np.ones(len(tokens)), 2)
    ids = {t: i for i, t in enumerate(tokens)}

    def cuts(data):
        if not data:
            yield []
        for n in range(1, len(data) + 1):
            if data[:n] in ids:
                yield from ([ids[data[:n]], *rest] for rest in cuts(data[n:]))

    words = ["abcab", "a", "bcbc", "é", "abcab"]
    got = langid.log_chances(words, pieces, model)
    counts = np.zeros(len(tokens))
    for k, word in enumerate(words):
        for m in range(2):
            total = sum(np.prod(model[m][c]) for c in cuts(b" " + word.encode()))
            assert got[k, m] == pytest.approx(math.log(total))
        ways = [(np.prod(model[0][c]), c) for c in cuts(b" " + word.encode())]
        for p, c in ways:
            np.add.at(counts, c, p / sum(x for x, _ in ways))
    assert langid.expected_counts(words, np.ones(len(words)), pieces, model[0]) == pytest.approx(counts)


def test_language_of_documents(spark):
    english, german = "the house and the garden are green", "das haus und der garten sind nicht klein"
    rows = [(i, english if i % 2 else german, "en" if i % 2 else "de", "a") for i in range(20)]
    model = langid.fit(docs_of(spark, rows).drop("lang_pred"))
    got = langid.predict(docs_of(spark), model)
    assert got.count() == len(DOCS)
    by_id = {r["doc_id"]: r for r in got.collect()}
    assert by_id[0]["lang_pred"] == "en" and by_id[6]["lang_pred"] == "de"
    assert all((by_id[i]["lang_pred"], by_id[i]["score"]) == ("und", 0.0) for i in (1, 2, 5))
    assert by_id[3]["lang_pred"] in ("en", "de") and 0 <= by_id[3]["score"] <= 1 and by_id[3]["_x"] == "clash"
    none = langid.fit(docs_of(spark, []))
    assert {r["lang_pred"] for r in langid.predict(docs_of(spark), none).collect()} == {"und"}
    assert langid.predict(docs_of(spark, []), model).count() == 0


ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
SECRETS = [
    'x Password = "abc123" token:a secret=abcdef', "token=token:abcdef", "AKIA" + "Z9" * 8, "AKIAAKIA1", "deadbeef" * 5 + " é😀 " + "0" * 24,
    "token=" + "0123456789abcdef" * 2 + ";", "", None, "key gX7kP2mQ9vL4tR8wZ1nB6cJ3 end", "thisisanordinarylongword1 and another_plain_name_2",
    "é" * 5 + " api_key: 'Zm9vYmFyMTIz'", "a" * 50_000 + " passwd=hunter22 " + "b" * 50_000, "secret=abcdef secret=abcdef", "AB12" * 12,
]


def brute_spans(text):
    out = []
    for kind, pattern, group, least in (("assign", ASSIGN, 2, 6), ("access", "AKIA[A-Z0-9]+", 0, 20), ("hex", "[0-9a-f]+", 0, 24)):
        out += [(m.start(), secrets.KINDS.index(kind), m.end()) for m in re.finditer(pattern, text or "") if len(m[group]) >= least]
    return sorted(out)


def test_secret_spans_and_masks(spark):
    df = docs_of(spark, [(i, t, "en", "a") for i, t in enumerate(SECRETS)])
    rows = {r["doc_id"]: [tuple(s) for s in r["spans"]] for r in secrets.scan(df).collect()}
    for i, text in enumerate(SECRETS):
        assert [s for s in rows[i] if s[1] < 3] == brute_spans(text)
    assert [s[1] for s in rows[8]] == [3] and SECRETS[8][rows[8][0][0] : rows[8][0][2]] == "gX7kP2mQ9vL4tR8wZ1nB6cJ3"
    assert rows[9] == [] and rows[13] == []  # names and repetitions are not random
    masked = {r["doc_id"]: r["text"] for r in secrets.redact(secrets.scan(df)).collect()}
    assert masked[12] == "[SECRET] [SECRET]" and masked[7] is None and masked[6] == ""
    assert masked[8] == "key [SECRET] end" and masked[5] == "[SECRET];"
    assert secrets.scan(docs_of(spark, [])).count() == 0


def test_mix_reaches_targets(spark):
    rng = np.random.default_rng(6)
    rows = [(i, " ".join(["w"] * int(n)), "en", s) for i, (n, s) in enumerate(zip(rng.integers(1, 60, 900), itertools.cycle(["a", "a", "a", "b", "é", None])))]
    got = mixing.mix(docs_of(spark, rows)).collect()
    again = mixing.mix(docs_of(spark, rows).repartition(2)).collect()
    assert sorted((r["doc_id"], r["copies"]) for r in got) == sorted((r["doc_id"], r["copies"]) for r in again)
    sizes = collections.Counter()
    for _, text, _, source in rows:
        sizes[source] += len(text.split())
    weight, open_, left, target = {"a": 3, "b": 1, "é": 2, None: 3}, set(sizes), 1.5 * sum(sizes.values()), {}
    while open_:  # share until nobody passes the limit
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * sizes[s]} or None
        for s in over or open_:
            target[s] = 2.0 * sizes[s] if over else level * weight[s]
        left -= sum(target[s] for s in over or ())
        open_ = open_ - over if over else set()
    taken = collections.Counter()
    for r in got:
        assert r["source_size"] == sizes[r["source"]] and r["target"] == pytest.approx(target[r["source"]]) and 0 <= r["copies"] <= 2
        taken[r["source"]] += r["copies"] * r["size"]
    assert all(0 <= target[s] - taken[s] <= 60 for s in sizes)
    assert mixing.mix(docs_of(spark, [])).count() == 0
    odd = mixing.mix(docs_of(spark)).collect()
    assert len(odd) == len(DOCS) and all(r["size"] == 0 for r in odd if not r["text"]) and odd[0]["key"] == "clash"


def test_repeated_rows_are_drawn_one_by_one(spark):
    """Half of a source under one id, and rows without id that agree: each source ends within one document of its target."""
    rows = [(7, "w " * 9 + str(i % 2), "en", "a") for i in range(500)] + [(1000 + i, "w " * 10, "en", "a") for i in range(500)]
    rows += [(None, "v " * 7, "en", "b")] * 300 + [(5000 + i, "v " * (1 + i % 9), "en", "b") for i in range(300)]
    runs = [mixing.mix(docs_of(spark, rows).repartition(n)).collect() for n in (2, 5)]
    for got in runs:
        taken, target = collections.Counter(), {r["source"]: r["target"] for r in got}
        for r in got:
            assert 0 <= r["copies"] <= 2
            taken[r["source"]] += r["copies"] * r["size"]
        assert len(got) == len(rows) and all(0 <= target[s] - taken[s] <= 10 for s in target)
        assert len({r["copies"] for r in got if r["doc_id"] == 7}) == 2
    one, two = (collections.Counter((r["doc_id"], r["size"], r["copies"]) for r in got) for got in runs)
    assert one == two


def test_mix_finds_the_edge_digit_by_digit(spark, monkeypatch):
    rows = [(i, "w " * (i % 9 + 1), "en", "ab"[i % 5 == 0]) for i in range(600)]
    want = sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs_of(spark, rows)).collect())
    monkeypatch.setattr(mixing, "EDGE_ROWS", 0)
    assert sorted((r["doc_id"], r["copies"]) for r in mixing.mix(docs_of(spark, rows)).collect()) == want


def test_packing(spark):
    tokenizer = Tokenizer.from_file(packing.TOKENIZER)
    rows = [*DOCS, (50, "a<|endoftext|>b", None, None), (51, " " * 30_000 + "x" * 5000, None, None), (52, "x " * 511, None, None)]
    got = packing.pack(docs_of(spark, rows), with_ids=True).collect()
    by_doc = collections.defaultdict(list)
    for r in got:
        by_doc[r["doc_id"]].append(r)
        assert r["length"] == len(r["ids"]) <= 1024 and r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    for key, text, *_ in rows:
        want = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        own = sorted(by_doc[key], key=lambda r: r["piece"])[:: 2 if key == 4 else 1]
        assert [i for r in own for i in r["ids"]] == want and [r["start"] for r in own] == list(np.cumsum([0, *(r["length"] for r in own)])[:-1])
        assert all(r["length"] == 1024 for r in own[1:])
    sequences = collections.defaultdict(list)
    for r in got:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in sequences.values():
        ends = 0
        for offset, length in sorted(parts):
            assert offset == ends
            ends += length
        assert ends <= 1024
    assert packing.pack(docs_of(spark, [])).count() == 0


def test_fullest_combination():
    rng = np.random.default_rng(7)
    for _ in range(200):
        counts = {int(n): int(rng.integers(1, 3)) for n in rng.integers(1, 40, 5)}
        room = int(rng.integers(1, 90))
        items = [n for n, k in counts.items() for _ in range(k)]
        best = max(s for k in range(len(items) + 1) for c in itertools.combinations(items, k) if (s := sum(c)) <= room)
        got = packing._fullest(counts, room)
        assert sum(got) == best and not collections.Counter(got) - collections.Counter(counts)
    plan = packing.plan({1024: 3, 600: 5, 424: 4, 10: 100}, 1024)
    assert plan.groupby("length")["count"].sum().to_dict() == {10: 100, 424: 4, 600: 5, 1024: 3}


def test_co_training_separates_and_keeps(spark):
    rng = np.random.default_rng(8)
    good, bad = ["river", "stone", "garden", "light"], ["click", "bonus", "cheap", "win"]
    rows = [(i, " ".join(rng.choice(good if i % 3 else bad, 40)), "en", f"s{i % 3}") for i in range(600)]
    labels = spark.createDataFrame([(i, int(bool(i % 3)), 0) for i in range(0, 600, 2)] + [(9999, 1, 0), (None, 1, 0), (0, None, 0)],
                                   "doc_id long, quality int, toxic int")
    docs = docs_of(spark, rows)
    got = {r["doc_id"]: r["label_pred"] for r in cotrain.score(docs, cotrain.fit(docs, labels)).collect()}
    assert sum(got[i] == bool(i % 3) for i in range(600)) > 590
    models = cotrain.fit(docs, labels.limit(0))
    odd = cotrain.score(docs_of(spark), models).collect()
    assert len(odd) == len(DOCS) and all(r["label_pred"] == 1 and r["score"] == 0.5 for r in odd)
    assert cotrain.score(docs_of(spark, []), cotrain.fit(docs_of(spark, []), labels)).count() == 0


def near_copies():
    rng = np.random.default_rng(9)
    words = [f"w{i}" for i in range(400)]
    rows, key = [], 0
    for size in (3, 9, 12, 20, 40, 90, 300, 900):
        for _ in range(6):
            text = list(rng.choice(words, size))
            for edits in (0, 0, 1, 1, 2, 3, size // 60, size // 40, size // 25):
                copy = list(text)
                for at in rng.integers(0, size, edits):
                    copy[at] = str(rng.choice(words)) if rng.random() < 0.7 else copy[at].upper()
                rows.append((key, " ".join(copy), "en", "a"))
                key += 1
    base = list(rng.choice(words, 150))
    for _ in range(60):  # one group with many members that share most segments
        copy = list(base)
        for at in rng.integers(0, 150, int(rng.integers(0, 9))):
            copy[at] = str(rng.choice(words))
        rows.append((key, "\n".join(copy), "en", "a"))
        key += 1
    return rows + [(key, "one", "en", "a"), (key + 1, "ONE", "en", "a"), (key + 2, "one two", "en", "a"), (key + 3, " \t", "en", "a")]


@pytest.mark.parametrize("settings", [{}, {"SMALL_BUCKET": 2, "BLOCK_ROWS": 5, "BLOCK_SHINGLES": 900, "BAND_SHARE": 5.0, "BIT_COLUMNS": 128}])
def test_jaccard_join_equals_brute_force(spark, monkeypatch, settings):
    for name, value in settings.items():
        monkeypatch.setattr(jaccard, name, value)
    rows = near_copies()
    rng = np.random.default_rng(1)
    rng.shuffle(rows)
    rows = [(int(r[0]), *r[1:]) for r in rows]
    sets = {}
    for key, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        sets[key] = {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) > 2 else {tuple(w)} if w else set()
    label = {k: k for k in sets}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if sets[a] and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])]
    for _ in range(60):
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r["id"]: r for r in jaccard.join(docs_of(spark, rows)).collect()}
    assert {k: r["n_shingles"] for k, r in got.items()} == {k: len(s) for k, s in sets.items()}
    assert {k: r["component_id"] for k, r in got.items()} == label and len(links) > 300
    kept = {r["doc_id"] for r in jaccard.dedup(docs_of(spark, rows)).collect()}
    assert kept == {k for k in label if label[k] == k}


def test_jaccard_on_awkward_rows(spark):
    got = jaccard.join(docs_of(spark)).collect()
    assert len(got) == len(DOCS)
    by_id = {r["id"]: r for r in got}
    assert by_id[4]["component_id"] == 0 and by_id[None]["component_id"] is None and by_id[1]["n_shingles"] == 0
    kept = jaccard.dedup(docs_of(spark)).collect()
    assert sorted(str(r["doc_id"]) for r in kept) == sorted(["0", "1", "2", "3", "None", "5", "6", "7"]) and kept[0]["key"] == "clash"
    assert jaccard.join(docs_of(spark, [])).count() == 0 and jaccard.dedup(docs_of(spark, [])).count() == 0


def test_skips_keep_the_pigeonhole():
    rng = np.random.default_rng(3)
    for _ in range(300):
        sizes = rng.integers(0, 6, int(rng.integers(1, 9)))
        skipped, widened = jaccard._skipped(sizes, min(len(sizes), 2), 1000.0)
        assert len(skipped) == len(widened) and not set(skipped) & set(widened)
        assert len(set(skipped)) == len(skipped) and len(set(widened)) == len(widened)
