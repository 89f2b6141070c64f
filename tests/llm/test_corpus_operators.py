"""Quality, line templates, containment, toxicity, the Jaccard join and the pipeline against plain versions."""

from __future__ import annotations

import collections
import random
import re
import zlib

import numpy as np
import pytest

import corpus_pipeline
from priorline.llm import decontaminate, jaccard, quality, queries, templates, toxicity

from . import plain

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def docs_of(spark, texts, ids=None):
    rows = [(i if ids is None else ids[i], t, "en", "s", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_quality_base(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    extra = docs_of(spark, [None, "", " \n\t", "a b c d e a b c d e f", "x y z w v " * 30, "one\none\n\none"], [900, 901, 902, 903, 904, None])
    both = docs.unionByName(extra)
    text = {r.doc_id: r.text or "" for r in both.collect()}
    for r in quality.judged(both, labels).collect():
        t = text[r.doc_id]
        w = WORD.findall(t)
        n = collections.Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
        covered = {j for i in range(len(w) - 4) if n[tuple(w[i : i + 5])] > 1 for j in range(i, i + 5)}
        lines = [x for x in t.split("\n") if WORD.search(x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered))
        assert r.base_failed == (len(w) < 10 or 100 * len(covered) > 20 * len(w))
        assert not (r.base_failed and r.kept)


def test_quality_score_and_verdict(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    out = quality.judged(docs, labels).toPandas()
    text, good = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id for r in labels.where("quality = 1").collect()}
    # The same n-grams by their hashes, counted in Python.
    from pyspark.sql import functions as F

    grams = {r.doc_id: r.b for r in docs.select("doc_id", quality.buckets(F.col("text")).alias("b")).collect()}
    raw, target = np.ones(quality.BUCKETS), np.ones(quality.BUCKETS)
    for i, b in grams.items():
        np.add.at(raw, b, 1)
        if i in good:
            np.add.at(target, b, 1)
    w = np.round(np.log(target / target.sum()) - np.log(raw / raw.sum()), 4)
    for r in out.itertuples():
        assert r.score == pytest.approx(w[grams[r.doc_id]].mean(), abs=2e-4)
        n = len(re.findall(r"[^\W_]+|[^\w\s]+|_+", text[r.doc_id]))
        assert len(grams[r.doc_id]) <= 2 * n + 4
    joined = out.merge(labels.toPandas(), on="doc_id")
    assert joined[joined.quality == 0].kept.mean() < 0.2 and joined[(joined.quality == 1) & ~joined.base_failed].kept.mean() > 0.9


def test_quality_without_labels_or_rows(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    out = quality.judged(docs_of(spark, ["a b c d e f g h i j k"]), labels).first()
    assert out.kept and out.score == 0
    assert quality.judged(docs_of(spark, []), labels).count() == 0


def plain_templates(lines: list[list[str]]) -> dict[tuple, tuple]:
    """The tree on distinct masked lines, in the order of their hashes."""
    leaves = collections.defaultdict(list)
    for line in lines:
        leaves[(len(line), *line[: templates.DEPTH])].append(line)
    out = {}
    order = lambda line: templates._signed(templates.xxhash.xxh3_64_intdigest(templates.token_hashes([w.encode() for w in line]).tobytes()))
    for own in leaves.values():
        held: list[list] = []
        names: list[tuple] = []
        for line in sorted(own, key=order):
            same = [sum(a == b for a, b in zip(t, line, strict=True) if a not in (None, "<*>")) for t in held]
            if same and max(same) >= templates.SIMILAR * len(line):
                k = same.index(max(same))
                held[k] = [a if a == b else None for a, b in zip(held[k], line, strict=True)]
                out[tuple(line)] = names[k]
            else:
                held.append(list(line))
                names.append(tuple(line))
                out[tuple(line)] = tuple(line)
    return out


def plain_without(texts: list[str]) -> list[str]:
    masked = [[["<*>" if re.search("[0-9]", w) else w for w in line.split()] for line in t.split("\n")] for t in texts]
    long = {tuple(x) for t in masked for x in t if len(x) >= templates.MIN_TOKENS}
    name = plain_templates([list(x) for x in long])

    def often(of):
        n = collections.Counter(x for x, _ in {(name[tuple(x)], of(i)) for i in range(len(texts)) for x in masked[i] if tuple(x) in name})
        return {x for x, c in n.items() if c >= templates.MIN_DOCS}

    again = often(lambda i: texts[i])
    holds = [i for i in range(len(texts)) if any(name.get(tuple(x)) in again for x in masked[i])]
    sets = {i: {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} for i in holds if (w := texts[i].lower().split())}
    root = {i: i for i in range(len(texts))}
    for i in sets:
        for j in sets:
            if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = {k: min(a, b) if r in (a, b) else r for k, r in root.items()}
    gone = again & often(lambda i: root[i])
    return ["\n".join(line for line, x in zip(t.split("\n"), masked[i], strict=True) if name.get(tuple(x)) not in gone) for i, t in enumerate(texts)]


def test_templates_equal_the_plain_tree(spark):
    rng = random.Random(8)
    vocabulary = [f"w{c}" for c in "abcdefghijklmnop"]
    own = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    common = [own(9), own(14), own(60)]
    texts = []
    for i in range(60):
        lines = [own(rng.randint(1, 30)) for _ in range(rng.randint(2, 6))]
        if i % 3 == 0:
            lines.insert(1, rng.choice(common))
        if i % 4 == 0:
            lines.append(f"Page {i} of {i * 7} printed on machine m{i} at last")
        if i % 5 == 0:
            line = common[2].split()
            line[rng.randint(5, 59)] = "changed"
            lines.append(" ".join(line))
        texts.append("\n".join(lines))
    texts += [texts[7], texts[7] + "\n\n", "", "short line", "\n\n"]
    got = {r.doc_id: r.text for r in templates.without_lines(docs_of(spark, texts)).collect()}
    want = plain_without(texts)
    assert [got[i] for i in range(len(texts))] == want
    assert not any(common[2] in got[i] for i in range(60)) and got[60] == texts[7]


def test_templates_one_rule_in_large_leaves(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("abcdefghij", k=3))
    # One leaf of 5,000 distinct lines that also agree in their first six words; the other words vary, or one name does.
    texts = [f"the same six words come first {word()} {word()} {word()} {word()}" for _ in range(4400)]
    texts += [f"the same six words come first {word()} but little else" for _ in range(600)]
    got = {r.doc_id: r.text for r in templates.without_lines(docs_of(spark, texts)).collect()}
    assert not any(got[i] for i in range(4400, 5000))
    # Every line as the plain rule names it, in the same order.
    name = plain_templates([t.split() for t in sorted(set(texts[:900] + texts[4900:]))])
    rows = {t: np.array([x | 1 for x in templates.token_hashes([w.encode() for w in t.split()]).tolist()], np.uint64).astype(np.uint32) for t in set(texts[:900] + texts[4900:])}
    order = lambda t: templates._signed(templates.xxhash.xxh3_64_intdigest(templates.token_hashes([w.encode() for w in t.split()]).tobytes()))
    leaf = templates.Leaf(10)
    for t in sorted(rows, key=order):
        first = leaf.join(order(t), rows[t])
        assert (first if first is not None else order(t)) == order(" ".join(name[tuple(t.split())]))


def test_templates_recur_across_components(spark):
    rng = random.Random(3)
    own = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    passage, other, inner = own(20), own(20), own(40)
    copied = f"{passage}\n{inner}\n{own(40)}"
    texts = [copied, copied + "\nthe end", f"{own(90)}\n{passage}", f"{passage}\n{other}", f"{own(90)}\n{other}", own(50)]
    left = {r.doc_id: r.text for r in templates.without_lines(docs_of(spark, texts)).collect()}
    # Near copies lose what they share with others and keep what they share with each other; patchworks lose all.
    assert not any(x in t for t in left.values() for x in (passage, other))
    assert all(inner in left[i] for i in (0, 1)) and left[0] == copied.split("\n", 1)[1]
    assert left[3] == "" and left[5] == texts[5]


def test_templates_edge_rows(spark):
    line = "all of this comes back again and again"
    docs = docs_of(spark, [None, "", f"{line}\nfirst of its own kind here now\nanother one that nobody has seen", f"something else was said before it\nand then more of the same\n{line}", f"{line}\nfirst of its own kind here now\nanother one that nobody has seen"], [1, 2, 3, None, 3])
    out = templates.without_lines(docs).collect()
    assert len(out) == 5 and {r.text for r in out if r.doc_id == 1} == {None}
    assert templates.without_lines(docs_of(spark, [])).count() == 0


def words(t: str) -> list[str]:
    return re.findall(r"[^\W_]+", t.lower())


def grams(t: str) -> set:
    w = words(t)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def test_containment_equals_brute_force(spark):
    rng = random.Random(3)
    own = lambda n: " ".join(rng.choice("abcdefghijklmnopqrstuvwxyz") + str(rng.randint(0, 40)) for _ in range(n))
    items = [own(rng.randint(5, 80)) for _ in range(25)] + ["too short", None, ""]
    texts = [own(rng.randint(0, 400)) for _ in range(60)]
    for i in range(40):
        w = items[i % 25].split()
        for _ in range(i // 8):
            w[rng.randrange(len(w))] = "zz9"
        texts[i] += " " + " ".join(w).upper() + ". " + own(30)
    texts += [None, "", texts[0]]
    bench = spark.createDataFrame([(i, t, 1) for i, t in enumerate(items)], "item_id long, text string, n int")
    docs = docs_of(spark, texts, [*range(len(texts) - 1), 0])
    got = {(r.doc_id, r.item_id, r.n_item_shingles, r.n_matched) for r in decontaminate.contaminated(docs, bench).collect()}
    want = set()
    for d, t in enumerate(texts[:-1]):
        for i, b in enumerate(items):
            q = grams(b or "")
            n = len(q & grams(t or ""))
            if q and 100 * n >= 80 * len(q):
                want.add((d, i, len(q), n))
    assert got == want and len(want) > 15
    kept = decontaminate.decontaminated(docs, bench)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(len(texts) - 1)) - {d for d, *_ in want}
    assert decontaminate.contaminated(docs, bench.limit(0)).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).count() == docs.count()
    assert decontaminate.contaminated(docs.limit(0), bench).count() == 0


def plain_components(texts, ids):
    def row(t):
        w = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])

    sets = [row(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    low = collections.defaultdict(list)
    for i in range(len(texts)):
        if ids[i] is not None:
            low[find(i)].append(ids[i])
    return sorted(((ids[i], len(sets[i]), min(low[find(i)]) if low[find(i)] else None) for i in range(len(texts))), key=str)


@pytest.mark.parametrize(("block", "hot_from"), [(64, 48), (3, 2), (6, 1000)])
def test_jaccard_equals_brute_force(spark, monkeypatch, block, hot_from):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", block)
    monkeypatch.setattr(jaccard, "HOT_FROM", hot_from)
    rng = random.Random(block)
    vocabulary = [f"w{i}" for i in range(400)]
    own = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    passage, texts = own(40), []
    for _ in range(12):
        base = own(rng.randint(4, 150))
        for _ in range(rng.randint(1, 14)):
            w = base[:]
            for _ in range(rng.randint(0, 4)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            if rng.random() < 0.2:
                w = w[: int(len(w) * 0.9)]
            texts.append(" ".join(w))
    texts += [" ".join(own(rng.randint(0, 60)) + passage) for _ in range(25)]
    texts += [None, "", "  \n", "a b", "A B", "a b c d e", "A b c d E", texts[0], texts[3].upper()]
    ids = [None if i % 37 == 5 else i for i in range(len(texts))]
    ids[-1] = 3
    docs = docs_of(spark, texts, ids)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()), key=str)
    assert got == plain_components(texts, ids)
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    empties = sum(1 for t in texts if not (t or "").split())
    keys = {(c[2] if c[2] is not None else str(c)) for c in got if c[1]}
    assert kept.count() == len(keys) + empties


def heavy_copies(rng, originals, copies, words, share):
    """Copies of texts that are not there themselves, each with up to ``share`` of its words changed in one run."""
    texts = []
    for o in range(originals):
        base = [f"b{o}x{i}" for i in range(words)]
        for c in range(copies):
            w, n = base[:], rng.randint(0, int(share * words))
            at = rng.randint(0, words - n)
            w[at : at + n] = [f"o{o}c{c}n{i}" for i in range(n)]
            texts.append(" ".join(w))
    return texts


@pytest.mark.parametrize("tile_rows,tile_bytes,block,hot_from", [(4, 16 << 20, 4, 6), (2048, 3000, 4, 6)])
def test_jaccard_open_groups_equal_brute_force(spark, monkeypatch, tile_rows, tile_bytes, block, hot_from):
    for name, value in (("TILE_ROWS", tile_rows), ("TILE_BYTES", tile_bytes), ("BLOCK_ROWS", block), ("HOT_FROM", hot_from)):
        monkeypatch.setattr(jaccard, name, value)
    used, plain = [], jaccard.tiled
    monkeypatch.setattr(jaccard, "tiled", lambda rows, sets: used.append(rows.count()) or plain(rows, sets))
    rng = random.Random(4)
    texts = heavy_copies(rng, 3, 24, 60, 0.3) + heavy_copies(rng, 1, 20, 200, 0.15) + [" ".join(f"f{i}" for i in range(50))]
    docs = docs_of(spark, texts)
    got = sorted(((r.doc_id, r.n_shingles, r.component_id) for r in jaccard.linked(docs).collect()), key=str)
    assert got == plain_components(texts, list(range(len(texts))))
    assert used, "no group was left for the tiles"


def test_jaccard_keeps_columns_of_any_name(spark):
    from pyspark.sql import functions as F

    docs = docs_of(spark, ["a b c d e f", "a b c d e f", "g h i j k l m"])
    odd = docs.select("*", *[F.lit(i).alias(n) for i, n in enumerate(("row_key", "row", "first", "n", "_pl_key", "_pl_kept", "a.b"))])
    kept = jaccard.one_of_each(odd)
    assert kept.columns == odd.columns and kept.count() == 2
    left = templates.without_lines(odd)
    assert left.drop("_pl_dropped").columns == odd.columns and left.count() == 3
    benchmark = spark.createDataFrame([(1, "g h i j k l m")], "item_id long, text string")
    clean = decontaminate.decontaminated(odd, benchmark)
    assert clean.columns == odd.columns and clean.count() == 2


def test_jaccard_empty_table(spark):
    assert jaccard.linked(docs_of(spark, [])).count() == 0
    assert jaccard.one_of_each(docs_of(spark, [None, ""])).count() == 2


def test_network_gradients():
    net = toxicity.Network(["a", "b", "c"], 1)
    net.p = {k: v.astype(np.float64) + (np.random.default_rng(0).standard_normal(v.shape) * 0.1 if v.ndim == 2 else 0) for k, v in net.p.items()}
    ids = np.array([[0, 1], [2, 0], [1, -1]])
    table = net.projected(net.features_of(["a", "b", "c"]))
    _, memo = net.run(table, ids, keep=True)
    grad, tables = net.back(memo, np.array([1.0, -0.5]), 3)

    def value():
        return float(net.run(table, ids) @ np.array([1.0, -0.5]))

    for name, got in [("uf", grad["uf"]), ("ub", grad["ub"]), ("att", grad["att"]), ("out", grad["out"])]:
        at = (1, 3) if got.ndim == 2 else (1,)
        net.p[name][at] += 1e-3
        up = value()
        net.p[name][at] -= 2e-3
        assert (up - value()) / 2e-3 == pytest.approx(float(got[at]), rel=0.02, abs=1e-4)
        net.p[name][at] += 1e-3
    for side in "fb":
        table[side][1, 2] += 1e-3
        up = value()
        table[side][1, 2] -= 2e-3
        assert (up - value()) / 2e-3 == pytest.approx(float(tables[side][1, 2]), rel=0.02, abs=1e-4)
        table[side][1, 2] += 1e-3


def test_windows_cover_whole_texts():
    for n in (0, 1, 64, 65, 112, 113, 1000):
        spans = list(toxicity.windows_of(n))
        assert spans[0][0] == 0 and spans[-1][1] == n
        assert all(b[0] < a[1] for a, b in zip(spans, spans[1:], strict=False)) and all(e - s <= 64 for s, e in spans)


def test_toxicity_learns_and_is_row_wise(spark):
    rng = random.Random(1)
    vocabulary = [f"w{a}{b}" for a in "abcdefghij" for b in "klmnopqrst"]
    texts, toxic = [], []
    for i in range(600):
        w = [rng.choice(vocabulary) for _ in range(rng.randint(5, 150))]
        toxic.append(int(i % 4 == 0))
        if toxic[-1]:
            for _ in range(3):
                w.insert(rng.randrange(len(w)), rng.choice(("scumbag", "vermin", "nastyface")))
        texts.append(" ".join(w))
    docs = docs_of(spark, [*texts, None, ""])
    labels = spark.createDataFrame([(i, 1, t) for i, t in enumerate(toxic)], "doc_id long, quality int, toxic int")
    net = toxicity.fit(docs, labels)
    got = {r.doc_id: r.score for r in toxicity.score(docs, net).collect()}
    held = [i for i in range(600) if zlib.crc32(str(i).encode()) % 4 == 2]
    right = np.mean([(got[i] >= queries.TOXIC_FROM) == bool(toxic[i]) for i in held])
    assert right > 0.95 and got[600] == got[601] and all(0 <= s <= 1 for s in got.values())
    alone = toxicity.Scorer(net).score([texts[5].split()])[0]
    assert alone == pytest.approx(got[5], abs=1e-5)
    kept = toxicity.below(docs, net, queries.TOXIC_FROM)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, s in got.items() if s < queries.TOXIC_FROM}


def test_toxicity_without_both_labels(spark):
    docs = docs_of(spark, ["a", None])
    one = spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int")
    assert [r.score for r in toxicity.score(docs, toxicity.fit(docs, one)).collect()] == [0.0, 0.0]


def test_toxicity_equals_word_by_word(spark):
    docs, labels = queries.table(spark, SF, "documents"), queries.table(spark, SF, "labels")
    net = toxicity.fit(docs, labels)
    long = docs.orderBy("n_chars", ascending=False).limit(3).unionByName(docs.limit(25))
    both = long.unionByName(docs_of(spark, [None, "", "?! ...", "x" * 5000, "a", "a"], [900, 901, 902, 903, None, 7]))
    text = {(r.doc_id, r.text) for r in both.collect()}
    got = sorted(r.score for r in toxicity.score(both.dropDuplicates(["doc_id", "text"]), net).collect())
    assert got == pytest.approx(sorted(plain.toxicity_score(net, t) for _, t in text), abs=1e-4)
    assert toxicity.score(docs.limit(0), net).count() == 0


def plain_lines(texts: list[str]) -> list[str]:
    """Without the lines whose template occurs in two components of the documents that hold such lines."""
    masked = [[["<*>" if re.search("[0-9]", w) else w for w in line.split()] for line in t.split("\n")] for t in texts]
    name = plain_templates([list(x) for x in {tuple(x) for t in masked for x in t if len(x) >= templates.MIN_TOKENS}])
    own = [{name[tuple(x)] for x in t if tuple(x) in name} for t in masked]
    often = {x for x, c in collections.Counter(x for o in own for x in o).items() if c >= templates.MIN_DOCS}
    holders = [i for i, o in enumerate(own) if o & often]
    component = {i: c for i, _, c in plain_components([texts[i] for i in holders], holders)}
    seen = collections.defaultdict(set)
    for i in holders:
        for x in own[i] & often:
            seen[x].add(component[i])
    gone = {x for x, c in seen.items() if len(c) >= templates.MIN_DOCS}
    return ["\n".join(line for line, x in zip(t.split("\n"), m, strict=True) if name.get(tuple(x)) not in gone) for t, m in zip(texts, masked, strict=True)]


def test_pipeline_equals_plain_stages(spark):
    docs = queries.table(spark, SF, "documents")
    extra = docs_of(spark, [None, "", "one two", docs.first().text], [90_001, 90_002, 90_003, 90_004])
    docs = docs.unionByName(extra)
    tox, lines, near, leaks, packing_ = (stage for _, stage in corpus_pipeline.STAGES)
    net = toxicity.fit(docs, queries.table(spark, SF, "labels"))
    rows = {r.doc_id: r.text for r in docs.collect()}

    kept = {r.doc_id: r.text for r in tox(spark, docs, SF).collect()}
    scores = {i: plain.toxicity_score(net, t) for i, t in rows.items()}
    sure = {i for i, s in scores.items() if abs(s - queries.TOXIC_FROM) > 1e-4}
    assert set(kept) & sure == {i for i in sure if scores[i] < queries.TOXIC_FROM}

    left = {r.doc_id: r.text for r in lines(spark, docs, SF).collect()}
    ids = sorted(rows)
    want = plain_lines([rows[i] or "" for i in ids])
    assert [left[i] or "" for i in ids] == want and left[90_001] is None

    one = {r.doc_id for r in near(spark, docs, SF).collect()}
    component = {i: (c if n else i) for i, n, c in plain_components([rows[i] for i in ids], ids)}
    assert one == set(component.values())

    items = [plain.grams(r.text) for r in queries.table(spark, SF, "benchmark").collect()]
    clean = {r.doc_id for r in leaks(spark, docs, SF).collect()}
    assert clean == {i for i, t in rows.items() if not plain.holds_item(t, items)}

    packed = packing_(spark, docs, SF).collect()
    by = collections.defaultdict(list)
    for r in packed:
        assert len(r.ids) == 4 * r.length and zlib.crc32(bytes(r.ids)) == r.ids_crc32
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        assert sum(n for _, n in parts) <= 4096 and [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))]
    assert {r.doc_id for r in packed} == set(rows)


def test_pipeline_of_an_empty_table(spark, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        queries.table(spark, SF, name).limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_pipeline(spark):
    out = corpus_pipeline.run(spark, SF)
    assert set(out.columns) >= {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} and out.count() > 100
    docs = queries.table(spark, SF, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
