import random
import time
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from treelens.llm import components, decontam, mixing, neardup, repetition


def _components(pairs, ids):
    up = {i: i for i in ids}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def _near(texts, width, percent):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    index, pairs = defaultdict(list), []
    for i in sorted(sets):
        common = Counter(j for s in sets[i] for j in index[s])
        pairs += [(i, j) for j, n in common.items() if 100 * n >= percent * (len(sets[i]) + len(sets[j]) - n)]
        for s in sets[i]:
            index[s].append(i)
    return {i: (len(sets[i]), c) for i, c in _components(pairs, sets).items()}


def test_near_duplicates_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    words = [f"w{i}" for i in range(400)]
    dice = random.Random(5)
    base = [dice.choice(words) for _ in range(120)]
    extra = []
    for k in range(260):  # one group larger than a block, with members on both sides of the threshold
        own = list(base)
        for _ in range(dice.randrange(12)):
            own[dice.randrange(len(own))] = dice.choice(words)
        extra.append((10_000 + k, " ".join(own)))
    extra += [(20_000, None), (20_001, ""), (20_002, " \t\x0b"), (20_003, "one two"), (20_004, "ONE two"), (20_005, "É two"), (20_006, "é two")]
    both = docs.unionByName(spark.createDataFrame(extra, "doc_id long, text string"))
    want = _near({r.doc_id: r.text for r in both.collect()}, 4, 80)
    got = neardup.near_duplicates(both.selectExpr("*", "1 as digest", "'x' as component_id"), 4, 80).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want
    assert all(r.kept == (r.doc_id == r.component_id) for r in got) and len(got) == len(want)


def test_near_duplicates_edges(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.component_id, r.kept) for r in neardup.near_duplicates(docs).collect())
    assert [g[0] for g in got] == [0, 1, 1, 2] and got[1][2] and not got[3][2]
    assert neardup.near_duplicates(docs.limit(0)).count() == 0
    assert sorted(r.doc_id or 0 for r in neardup.drop_near_duplicates(docs).collect()) == [0, 1, 1]


def test_large_buckets_lose_no_link(spark):
    """Many texts that share buckets without being one component: cut into blocks, nothing is lost."""
    dice = random.Random(15)
    words = [f"w{i}" for i in range(3000)]
    base = [dice.choice(words) for _ in range(90)]
    texts = {}
    for k in range(420):
        own = list(base)
        for _ in range(dice.choice([4, 6, 7, 8, 9])):  # most pairs are below the limit, some above
            own[dice.randrange(len(own))] = dice.choice(words)
        texts[k] = " ".join(own)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    before, (neardup.SMALL, neardup.BLOCK) = (neardup.SMALL, neardup.BLOCK), (8, 16)
    try:
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in neardup.near_duplicates(docs, 4, 80).collect()}
    finally:
        neardup.SMALL, neardup.BLOCK = before
    want = _near(texts, 4, 80)
    assert len({c for _, c in want.values()}) > 60 and got == want


def test_superminhash_is_the_sequential_algorithm_and_estimates():
    slots = 16
    sets = [neardup.shingles(" ".join(f"w{i}" for i in range(n)), 2, neardup.WordHashes()) for n in (2, 3, 9, 200)]
    for own, got in zip(sets, neardup.superminhash(sets, slots), strict=True):
        want = [None] * slots
        for x in own:
            p = list(range(slots))
            for j in range(slots):
                z = int(neardup.mix(np.array([int(x) + (j + 1) * int(neardup._MUL) & (2**64 - 1)], np.uint64))[0])
                k = j + ((z >> 32) * (slots - j) >> 32)
                p[j], p[k] = p[k], p[j]
                value = j << 32 | (z & 0xFFFFFFFF)
                want[p[j]] = value if want[p[j]] is None else min(want[p[j]], value)
        assert want == got.tolist()
    a = neardup.shingles(" ".join(map(str, range(1000))), 1, neardup.WordHashes())
    one, two = neardup.superminhash([a[:800], a[200:]], 128)
    assert abs((one == two).mean() - 0.6) < 0.15


def test_components(spark):
    dice = random.Random(2)
    pairs = [(dice.randrange(300), dice.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(400, 460)] + [(1000, k) for k in range(1001, 1100)] + [(7, 7)]
    got = {r.id: r.component for r in components.connected_components(spark.createDataFrame(pairs, "src long, dst long")).collect()}
    pairs = [p for p in pairs if p[0] != p[1]]
    want = _components(pairs, {x for p in pairs for x in p})
    assert got == want


@settings(max_examples=120, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=40))
def test_longest_repeats(codes):
    n = len(codes)
    want = []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and max(i, j) + k < n and codes[i + k] == codes[j + k]:
                k += 1
            best = max(best, k)
        want.append(best)
    assert repetition.longest_repeats(np.array(codes, np.int64)).tolist() == want


def test_quality_rules(spark):
    clean = " ".join(f"word{i}" for i in range(80))
    repeated = clean + "\n" + clean
    rows = [(1, None), (2, ""), (3, clean), (4, repeated), (5, "# a\n# a\n\n \nb|b"), (None, clean), (3, clean), (6, "x y z " * 50000)]
    got = {(r.doc_id or 0): r for r in repetition.quality_rules(spark.createDataFrame([(*r, True) for r in rows], "doc_id long, text string, kept boolean")).collect()}
    assert got[1].n_words == 0 and got[1].base_failed and not got[1].kept and got[3].kept and got[0].kept
    assert got[4].n_repeat_words == 160 and got[4].base_failed and got[4].longest_repeat == 80 and got[4].n_dup_lines == 1
    assert (got[5].n_words, got[5].word_chars, got[5].n_symbols, got[5].n_dup_lines) == (5, 7, 3, 1)
    assert got[6].n_repeat_words == 150000 and not got[6].kept
    # long single repeat beyond a quarter of the words, though the base rule passes
    text = " ".join([f"p{i}" for i in range(100)] + [f"q{i}" for i in range(75)] + [f"r{i}" for i in range(5)] + [f"q{i}" for i in range(75)] + [f"s{i}" for i in range(45)])
    row = repetition.judge(text, 8, 90, 20, 50)
    assert row[-1] == 75 and row[-2] == 150 and not row[-3] and not row[5]


def test_quality_counts_equal_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got = {r.doc_id: r for r in repetition.quality_rules(docs).collect()}
    for r in docs.collect():
        w = [x.decode() for x in r.text.encode().split()]
        grams = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        inside = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in (i, i + 1, i + 2)}
        lines = Counter(x for x in r.text.split("\n") if x.encode().split())
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in r.text), sum(lines.values()) - len(lines), len(inside))
        g = got[r.doc_id]
        assert (g.n_words, g.word_chars, g.n_symbols, g.n_dup_lines, g.n_repeat_words) == want


def _edited(text, edits, dice):
    chars = list(text)
    for _ in range(edits):
        k, what = dice.randrange(len(chars)), dice.random()
        if what < 0.4:
            chars[k] = dice.choice("abcxyz")
        elif what < 0.7:
            del chars[k]
        else:
            chars.insert(k, dice.choice("abc "))
    return "".join(chars)


def test_decontamination_finds_edited_passages_and_nothing_else(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet("/root/testdata/sf0.01/benchmark.parquet")
    dice = random.Random(1)
    items = {r.item_id: r.text for r in bench.collect()}
    filler = " ".join(f"zq{i}x" for i in range(200))
    planted, want = [], set()
    for k in range(60):
        item = dice.choice(sorted(items))
        text = decontam.normalise(items[item])
        planted.append((50_000 + k, f"{filler[: dice.randrange(900)]} {_edited(text, dice.randint(0, int(0.08 * len(text))), dice)} {filler}"))
        want.add((50_000 + k, item))
    planted += [(60_000, None), (60_001, ""), (60_002, filler * 40), (None, items[0])]
    both = docs.unionByName(spark.createDataFrame(planted, "doc_id long, text string"))
    want |= {(r.doc_id, i) for r in docs.collect() for i, t in items.items() if decontam.normalise(t) in decontam.normalise(r.text)}
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(both.selectExpr("*", "'e' as edits"), bench).collect()}
    assert got == want | {(None, 0)}
    # blocks of the benchmark give the same result as one
    assert got == {(r.doc_id, r.item_id) for r in decontam.contaminated(both, bench, max_block_chars=2000).collect()}
    assert decontam.contaminated(both, bench.limit(0)).count() == 0 and decontam.contaminated(both.limit(0), bench).count() == 0
    for options in ({}, {"max_block_chars": 2000}):
        kept = decontam.drop_contaminated(both, bench, **options)
        assert kept.count() == both.count() - len({d for d, _ in got})
    # each row by its own text
    pair = spark.createDataFrame([(1, items[0]), (1, filler), (None, items[0]), (None, filler), (None, None)], "doc_id long, text string")
    assert [r.text for r in decontam.drop_contaminated(pair, bench).orderBy("text").collect()] == [None, filler, filler]


def _plain_alignment(item, text):
    """Least edits of the whole of ``item`` anywhere in ``text``."""
    cost = np.zeros(len(text) + 1, np.int64)
    steps = np.arange(len(text) + 1)
    own = np.array([ord(c) for c in text])
    for c in item:
        new = np.minimum(cost + 1, np.concatenate([[1 << 30], cost[:-1] + (own != ord(c))]))
        cost = np.minimum.accumulate(new - steps) + steps
    return int(cost.min())


def test_decontamination_equals_plain_alignment_of_every_pair(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect() if len(r.text) < 2500][:70]
    dice = random.Random(12)
    items = {r.item_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").orderBy("item_id").limit(12).collect()}
    for k, (i, t) in enumerate(sorted(items.items()) * 4):  # on both sides of the limit
        own = decontam.normalise(t)[:150].strip()
        items[i] = own
        docs.append((10**6 + k, "zz qq " * dice.randrange(20) + _edited(own, dice.randint(0, int(0.13 * len(own))), dice) + " yy"))
    docs.append((10**7, "word " * 40000 + items[min(items)] + " x" * 1000))
    want = set()
    for d, t in docs[:-1]:
        text = decontam.normalise(t)
        want |= {(d, i) for i, own in items.items() if _plain_alignment(own, text) <= int(0.08 * len(own))}
    want.add((10**7, min(items)))
    assert len(want) > 25
    bench = spark.createDataFrame(sorted(items.items()), "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontam.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), bench).collect()}
    assert got == want


def test_repeated_passages_take_linear_time_and_the_best_is_reported():
    passage = "seven grey herons stood in the shallow water below the old mill and none of them moved while the boats went by that morning"
    items = decontam.Items([(5, passage)], 0.08, 40)
    near = passage.replace("grey", "gray")
    for copies in ([passage] * 2000, [near] * 2000, [near] * 1999 + [passage]):
        text = " then again ".join(copies)
        begun = time.process_time()
        (got,) = decontam._found(text, items)
        assert time.process_time() - begun < 10  # 20 seconds and more when each copy is aligned on its own
        edits = 0 if passage in copies else 1
        assert got == (5, text.index(passage if edits == 0 else near), text.index(passage if edits == 0 else near) + len(passage), edits, len(passage))


def test_alignment_equals_a_plain_table():
    rng = random.Random(4)
    for _ in range(300):
        item, regions = "".join(rng.choices("ab ", k=rng.randint(1, 20))), ["".join(rng.choices("ab ", k=rng.randint(0, 30))) for _ in range(3)]
        got = decontam.align(decontam.codes(item), [decontam.codes(r) for r in regions], 4)
        for region, hit in zip(regions, got, strict=True):
            rows = [[(0, b) for b in range(len(region) + 1)]]
            for k, c in enumerate(item):
                rows.append([(k + 1, 0)])
                for j, t in enumerate(region):
                    ways = ((rows[k][j], c != t), (rows[k][j + 1], 1), (rows[k + 1][j], 1))
                    rows[k + 1].append(min((edits + more, begin) for (edits, begin), more in ways))
            best = min((*cell, end) for end, cell in enumerate(rows[-1]))
            assert hit == (best if best[0] <= 4 else None)


def test_plain_and_other_texts_are_normalised_alike():
    for text in ("A_b--C\t9\x1f!", "".join(map(chr, range(128))), "", " ", None, "x" * 3):
        assert decontam.normalise(text) == (decontam._SEPARATORS.sub(" ", text.lower()).strip() if text else "")


def test_decontamination_refuses_what_the_lemma_cannot_promise(spark):
    docs = spark.createDataFrame([(1, "text")], "doc_id long, text string")
    bench = spark.createDataFrame([(1, "passage " * 12)], "item_id long, text string")
    for rate in (0.1, 0.125):
        with pytest.raises(ValueError):
            decontam.contaminated(docs, bench, rate=rate)


def test_decontamination_finds_parts_and_short_passages(spark):
    dice = random.Random(6)

    def fresh(n):
        return " ".join("".join(dice.choice("abcdefghij") for _ in range(dice.randint(3, 9))) for _ in range(n))

    long, filler = fresh(1000), fresh(80)
    bench = spark.createDataFrame([(1, long), (2, "Short answer: 42"), (3, "?!")], "item_id long, text string")
    quotes = {k: long[(at := dice.randrange(len(long) - 160)) : at + 160] for k in range(40)}
    rows = [(k, f"{filler} {_edited(q, dice.randint(0, 11), dice)} {filler}") for k, q in quotes.items()]
    rows += [(100, long[len(long) // 5 :] + filler), (101, filler + long[: len(long) // 2]), (102, " ".join(long.split()[300:600]))]
    rows += [(200, f"{filler}, short ANSWER 42!"), (201, "short answer 421"), (202, filler), (203, long[:90] + filler)]
    got = decontam.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()
    assert sorted((r.doc_id, r.item_id) for r in got) == [(k, 1) for k in (*quotes, 100, 101, 102)] + [(200, 2)]


def test_mix(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = mixing.mix(docs).toPandas()
    sizes = docs.select("doc_id", "source", "text").toPandas().set_index("doc_id")
    sizes["n"] = sizes.text.map(lambda t: len(t.encode().split()))
    got["source"] = got.doc_id.map(sizes.source)
    assert (got["size"] == got.doc_id.map(sizes.n)).all() and (got.taken <= 3 * got["size"]).all() and (got.taken >= 0).all()
    # targets by the iterative definition
    names, own = sorted(set(sizes.source)), sizes.groupby("source").n.sum()
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    left, open_, target = float(own.sum()), set(names), {}
    while open_:
        per = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if weight[s] * per > 3 * own[s]}
        if not full:
            target |= {s: weight[s] * per for s in open_}
            break
        target |= {s: 3.0 * own[s] for s in full}
        left -= sum(3.0 * own[s] for s in full)
        open_ -= full
    for s, part in got.groupby("source"):
        assert np.isclose(part.target.iloc[0], target[s]) and abs(part.taken.sum() - target[s]) <= 0.01 * target[s] + 64
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert again.set_index("doc_id").taken.sort_index().equals(got.set_index("doc_id").taken.sort_index())


def test_mix_edges(spark):
    rows = [(1, "a b c " * 400, "s"), (2, None, "s"), (3, "", None), (None, "x y " * 300, None), (4, "w", "t"), (4, "w", "t"), (5, "k " * 90000, "big")]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, source string, taken int")
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(0 <= r.taken <= 3 * r.size for r in got)
    assert mixing.mix(docs.limit(0)).count() == 0
    assert all(r.target == 0 and r.taken == 0 for r in mixing.mix(docs.where("text is null or text = ''")).collect())


def test_mix_of_whole_documents(spark):
    rows = [(1, "a b c " * 400, "s", "x"), (1, "a b c " * 400, "s", "x"), (1, "a b c " * 400, "s", "y"), (None, "k " * 500, None, None), (None, None, None, "z"), (2, "w " * 90, "t", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, `a.b` string").selectExpr("*", "1 as taken", "2 as _order", "3 as _row")
    got = mixing.mix_documents(docs)
    assert got.columns == ["doc_id", "text", "source", "a.b", "_order", "_row", "size", "source_size", "target", "taken"]
    got = got.collect()
    key = lambda r: tuple("" if x is None else str(x) for x in r)
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(rows, key=key)
    assert sorted(key((r.doc_id, r.size, r.target, r.taken)) for r in got) == sorted(key((r.doc_id, r.size, r.target, r.taken)) for r in mixing.mix(docs).collect())
    assert sum(r.taken for r in got if r.doc_id is None) > 0
    assert mixing.mix_documents(docs.limit(0)).count() == 0


def test_large_ids_beside_null_ids(spark):
    big = 2**62 + 1
    docs = spark.createDataFrame([(big, "alpha beta gamma delta epsilon " * 4), (None, "alpha beta gamma delta epsilon " * 4), (big + 2, "one two three four five six")], "doc_id long, text string").coalesce(1)
    assert {r.doc_id for r in neardup.near_duplicates(docs).collect()} == {r.doc_id for r in repetition.quality_rules(docs).collect()} == {big, big + 2, None}
    bench = spark.createDataFrame([(7, "alpha beta gamma delta epsilon alpha beta gamma delta")], "item_id long, text string")
    assert {r.doc_id for r in decontam.contaminated(docs, bench).collect()} == {big, None}
    assert {r.doc_id for r in decontam.drop_contaminated(docs, bench).collect()} == {big + 2}


def test_apportionment_is_sainte_lague(spark):
    dice = random.Random(4)
    for seats in (0, 1, 7, 100, 1001):
        votes = [(i, dice.choice([0, 1, 3, dice.randrange(1, 5000)])) for i in range(30)]
        order = sorted(((-v / (2 * k + 1), i) for i, v in votes if v for k in range(seats + 1)))[:seats]
        want = Counter(i for _, i in order)
        df = spark.createDataFrame([(0, i, v, seats) for i, v in votes], "g int, i int, v long, s long")
        from pyspark.sql import functions as F

        got = {r.i: r.quota for r in mixing.apportion(df, ["g"], F.col("i"), F.col("v"), F.col("s")).collect()}
        assert got == {i: want.get(i, 0) for i, _ in votes}
