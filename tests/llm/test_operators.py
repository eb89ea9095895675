"""Each operator against a plain version on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns."""

from __future__ import annotations

import hashlib
import random
import re
import time
import zlib
from collections import Counter

import pytest
import tiktoken

from tagloom.llm import byte_bpe, chat_trees, common, decontamination, exact_dedup, jaccard_join, language_id, line_dedup, pii, suffix_dedup, toxicity
from tagloom.llm.components import components

#: A table of documents with extra columns whose names the operators use inside.
DOCS = "doc_id long, text string, lang string, source string, n_chars long, id long, tid long, sid long, n long, key long, digest string, spans string, score double"


def documents(spark, texts, langs=None):
    rows = [(i if i is None or isinstance(i, int) else i, t) for i, t in (texts if texts and isinstance(texts[0], tuple) else list(enumerate(texts)))]
    return spark.createDataFrame([(i, t, (langs or {}).get(i), "s", 0, -1, -1, -1, -1, -1, "x", "y", 0.5) for i, t in rows], DOCS)


def by_id(df):
    return {r.doc_id: r for r in df.collect()}


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


ODD = [None, "", " ", "a", "a  b\n", "é 😀 \x00 x", "word " * 3000, "x" * 30_000, "a b", "a b"]


@pytest.fixture(scope="module")
def mixed():
    """Texts with copies, near copies and shared passages."""
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdeé", k=rng.randint(1, 7))) for _ in range(300)]
    make = lambda n: " ".join(rng.choices(words, k=n))
    texts, passage = list(ODD), make(45)
    for _ in range(40):
        t = make(rng.randint(1, 150)).split(" ")
        texts.append(" ".join(t))
        for _ in range(rng.randint(0, 3)):
            u = list(t)
            for _ in range(rng.randint(0, 4)):
                u[rng.randrange(len(u))] = rng.choice(words)
            texts.append((" ".join(u) + rng.choice(["", " ", "\n"])).upper() if rng.random() < 0.2 else " ".join(u))
        if rng.random() < 0.4:
            texts.append(make(20) + " " + passage + " " + make(rng.randint(0, 40)))
    return texts


# exact dedup

def test_exact(spark, mixed):
    texts = [*enumerate(mixed), (None, "a b"), (5, mixed[5]), (5, mixed[5])]
    groups: dict[str, list] = {}
    for i, t in texts:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]", "", t or ""), []).append((-len(t or ""), i is None, i or 0, i))
    for counters in (2, 1000):
        rows = exact_dedup.exact_groups(documents(spark, texts), counters=counters).collect()
        assert len(rows) == len(texts)
        found = Counter((bytes(r.digest).hex(), r.n, r.keep) for r in rows)
        assert found == Counter({(sha(k), len(v), min(v)[3]): len(v) for k, v in groups.items()})
        kept = Counter(bytes(r.digest).hex() for r in rows if r.kept)
        assert kept == Counter(sha(k) for k in groups)
    left = exact_dedup.exact_dedup(documents(spark, texts))
    assert left.columns == documents(spark, [""]).columns
    assert {r.doc_id for r in left.collect()} == {min(v)[3] for v in groups.values()} | {None}


def test_exact_dedup_decides_by_row(spark):
    texts = [(1, "again")] * 60 + [(3, "three"), (5, "three"), (5, "only here"), (None, "no id"), (None, "no id"), (7, "near")] + [(None, "near")] * 3
    for counters in (2, 1000):
        left = Counter((r.doc_id, r.text) for r in exact_dedup.exact_dedup(documents(spark, texts), counters=counters).collect())
        assert left == Counter([(1, "again"), (3, "three"), (5, "only here"), (None, "no id"), (7, "near"), (None, "near")])


def test_exact_finds_a_digest_that_each_partition_holds_once(spark):
    rows = [(i, "spread" if i % 50 == 0 else f"own {i}") for i in range(3000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartitionByRange(60, "doc_id")
    digests = docs.select(exact_dedup.F.unhex(exact_dedup.F.sha2("text", 256)).alias("digest"))
    assert hashlib.sha256(b"spread").digest() in exact_dedup.frequent_digests(digests, counters=80)


def test_misra_gries_holds_what_is_frequent():
    rng = random.Random(1)
    items = [b"hot"] * 400 + [bytes([rng.randrange(256), rng.randrange(256)]) for _ in range(900)]
    rng.shuffle(items)
    parts = [exact_dedup.misra_gries(iter(items[i::4]), 4) for i in range(4)]
    assert b"hot" in exact_dedup.merge_summaries(parts, 4)


# byte-level BPE

def test_bpe_is_the_library(spark, mixed):
    path, pattern = byte_bpe.public_vocabulary()
    library = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=byte_bpe.read_ranks(path), special_tokens={})
    rng = random.Random(2)
    texts = [*mixed, "<|endoftext|>", *("".join(rng.choices(" ab.'s\n\t  é中😀 12  the", k=rng.randint(0, 60))) for _ in range(300))]
    docs = documents(spark, texts)
    encoded = byte_bpe.encode(docs, path, pattern)
    found, back, digests = by_id(encoded), by_id(byte_bpe.decode(encoded, path, pattern)), by_id(byte_bpe.digests(docs, path, pattern))
    for i, t in enumerate(texts):
        want = library.encode_ordinary(t or "")
        assert found[i].ids == want
        assert bytes(back[i].data) == (t or "").encode()
        assert (digests[i].n_tokens, digests[i].ids_sha256, digests[i].decoded_sha256) == (len(want), sha(" ".join(map(str, want))), sha(t or ""))


def test_bpe_appends_and_edits():
    merges = byte_bpe.Merges(byte_bpe.read_ranks(byte_bpe.public_vocabulary()[0]))
    rng = random.Random(3)
    for _ in range(100):
        a, x = (bytes(rng.choices(b"the in of abcd", k=rng.randint(0, n))) for n in (200, 9))
        i = rng.randint(0, len(a))
        j = rng.randint(i, len(a))
        table = byte_bpe.PrefixTable(merges, a)
        table.edit(i, j, x)
        assert table.ids() == byte_bpe.PrefixTable(merges, a[:i] + x + a[j:]).ids()
        table.append(x)
        assert table.ids() == byte_bpe.PrefixTable(merges, a[:i] + x + a[j:] + x).ids()
    long = byte_bpe.PrefixTable(merges, b"the cat sat on the mat " * 500)
    assert long.edit(5, 6, b"u") < 500  # near the edit, not all behind it


def test_bpe_long_pieces_take_little_time(spark):
    merges = byte_bpe.Merges(byte_bpe.read_ranks(byte_bpe.public_vocabulary()[0]))
    codec = byte_bpe.Codec(merges, byte_bpe.public_vocabulary()[1])
    library = tiktoken.Encoding("own", pat_str=byte_bpe.public_vocabulary()[1], mergeable_ranks=merges.ranks, special_tokens={})
    for text in ("\u4e2d\u6587" * 2000, "-" * 3000, "abab" * 1500, "\u0e20\u0e32\u0e29\u0e32" * 900):
        assert codec.encode(text) == " ".join(map(str, library.encode_ordinary(text)))
    began = time.process_time()
    codec.encode("\u4e2d\u6587" * 80_000)  # 480 KB without a space
    assert time.process_time() - began < 10  # about 1 s; in 28 s when nothing was remembered


# Jaccard join

def plain_sets(texts):
    out = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
        out.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    return out


def plain_components(sets):
    comp = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= 75 * len(sets[i] | sets[j]) and comp[i] != comp[j]:
                comp = [min(comp[i], comp[j]) if c in (comp[i], comp[j]) else c for c in comp]
    return comp


def test_jaccard(spark, mixed):
    rng = random.Random(4)
    base = [f"w{k}" for k in range(40)]
    chain = []
    for i in range(60):  # near copies of near copies
        t = list(base)
        t[i % 40] = t[(3 * i + 1) % 40] = f"x{rng.randrange(9)}"
        chain.append(" ".join(t))
    texts = [*mixed, *chain]
    sets = plain_sets(texts)
    want = plain_components(sets)
    got = by_id(jaccard_join.jaccard_groups(documents(spark, texts)))
    assert [got[i].n_shingles for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i].component_id for i in range(len(texts))] == want
    assert len(set(want)) < len(texts) - 30
    left = {r.doc_id for r in jaccard_join.keep_one(documents(spark, texts)).collect()}
    assert left == set(want)


def test_jaccard_keeps_one_row(spark):
    base = [f"w{k}" for k in range(60)]
    near, other = " ".join([*base, "x"]), " ".join(f"v{k}" for k in range(60))
    texts = [(9, near), (3, " ".join(base)), (5, near + " y"), (5, other), (None, near), (3, " ".join(base)), (6, ""), (6, "")]
    left = Counter((r.doc_id, r.text) for r in jaccard_join.keep_one(documents(spark, texts)).collect())
    assert left == Counter([(3, " ".join(base)), (5, other), (6, ""), (6, "")])


@pytest.mark.parametrize("rounds", [0, 2])
def test_jaccard_in_any_order_of_shingles(spark, mixed, rounds, monkeypatch):
    cells = 1 << jaccard_join.BITS
    monkeypatch.setattr(jaccard_join, "frequency_levels", lambda counts: jaccard_join.np.random.default_rng(3).integers(0, 256, cells).astype("u1"))
    monkeypatch.setattr(jaccard_join, "ROUNDS", rounds)
    got = by_id(jaccard_join.jaccard_groups(documents(spark, mixed)))
    assert [got[i].component_id for i in range(len(mixed))] == plain_components(plain_sets(mixed))


@pytest.mark.parametrize("held", [400, 4_000_000])
def test_jaccard_in_blocks_of_regions(spark, mixed, held, monkeypatch):
    monkeypatch.setattr(jaccard_join, "HELD", held)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    long = [" ".join(f"z{k}" if k % 97 != i else f"y{i}" for k in range(700)) for i in range(6)]
    texts = mixed + long
    got = by_id(jaccard_join.jaccard_groups(documents(spark, texts)))
    assert [got[i].component_id for i in range(len(texts))] == plain_components(plain_sets(texts))


def test_jaccard_makes_no_table_of_pairs(spark, monkeypatch):
    rng, rows, write = random.Random(8), Counter(), jaccard_join.materialize

    def counted(df, label, **more):
        df = write(df, label, **more)
        rows[label] = max(rows[label], df.count())
        return df

    monkeypatch.setattr(jaccard_join, "materialize", counted)
    monkeypatch.setattr(jaccard_join, "ROUNDS", 0)
    linked = [[f"w{k}" for k in range(150)] for _ in range(80)]
    for i, t in enumerate(linked):
        t[rng.randrange(150)] = f"x{i}"
    apart = [[f"v{k}" for k in range(120)] + [f"v{i}-{k}" for k in range(24)] for i in range(80)]  # 116 shingles of 164 are shared
    texts = [" ".join(t) for t in linked + apart]
    got = by_id(jaccard_join.jaccard_groups(documents(spark, texts)))
    assert [got[i].component_id for i in range(160)] == [0] * 80 + list(range(80, 160))
    assert max(rows[x] for x in ("pairs", "candidates", "linked")) <= 10 * len(texts)  # not the 3,160 pairs of either group


def test_jaccard_moves_only_what_two_texts_have(spark, monkeypatch):
    sent, points, run, write = [], {}, jaccard_join.arrow, jaccard_join.materialize

    def counted(df, f, schema, **more):
        df = run(df, f, schema, **more)
        if schema == "key long, sid long, at int":  # a key of a prefix each
            sent.append(df.count())
        return df

    def noted(df, label, **more):
        df = write(df, label, **more)
        if label == "pairs":  # tables of points that are still there when pairs are compared
            for path in common._tables:
                if path not in before and "point" in (kept := spark.read.parquet(path)).columns:
                    points[path] = kept.count()
        return df

    before = set(common._tables)
    monkeypatch.setattr(jaccard_join, "arrow", counted)
    monkeypatch.setattr(jaccard_join, "materialize", noted)
    own = [[f"w{i}-{k}" for k in range(300)] for i in range(40)]
    texts = [" ".join(t) for t in [*own, [*own[7][:299], "x"], own[9]]]
    got = by_id(jaccard_join.jaccard_groups(documents(spark, texts)))
    assert [got[i].component_id for i in range(42)] == [*range(40), 7, 9]
    assert 75 <= sum(sent) <= 1500  # prefixes hold 3,000 keys, 225 of them of the texts that have a copy or a near copy
    assert points and sum(points.values()) <= 20


def test_region_trees_find_every_link():
    rng = random.Random(12)
    base = [str(k) for k in range(90)]
    sets = []
    for _ in range(150):  # more points than a leaf holds
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(90)] = rng.choice("xyz")
        sets.append(jaccard_join.shingles(" ".join(t).encode()))
    sets = [s for s in sets if sets[0][0] in s]
    at = jaccard_join.np.array([int((s < sets[0][0]).sum()) for s in sets])  # ordered by hash
    tree = jaccard_join.Tree([jaccard_join.Point(jaccard_join.point(s)) for s in sets], jaccard_join.np.arange(len(sets)), at)
    found = {(min(a, b), max(a, b)) for x, y in tree.pairs() for a, b in zip(x.tolist(), y.tolist(), strict=True)}
    both = lambda a, b: len(jaccard_join.np.intersect1d(sets[a], sets[b]))
    links = {(a, b) for b in range(len(sets)) for a in range(b) if 7 * both(a, b) >= 3 * (len(sets[a]) + len(sets[b]))}
    assert len(sets) > 60 and links and links <= found


def test_sets_whose_first_bits_clash(spark):
    rows = spark.createDataFrame([(1, 5, 10, 3, b"a"), (2, 5, 11, 4, b"b"), (3, 5, 10, 3, b"a"), (4, 6, 12, 2, b"c"), (5, 7, 1, 0, b"")], "id long, sid long, other long, n long, point binary")
    rows, points, names = jaccard_join._named_points(rows)
    assert sorted((r.id, r.sid) for r in rows.collect()) == [(1, 10), (2, 11), (3, 10), (4, 6), (5, 7)]
    assert sorted((r.sid, r.id, r.n) for r in points.collect()) == [(6, 4, 2), (10, 1, 3), (11, 2, 4)]
    s = jaccard_join.shingles(b"some text")
    first, other = jaccard_join.set_id(s)
    assert names.clashes == {5} and names.of(s) == first and jaccard_join.Names(frozenset([first])).of(s) == other


def test_points_bound_the_overlap():
    rng = random.Random(5)
    for n in (3, 60, 511, 513, 900, 3000):
        a, b = (jaccard_join.shingles(" ".join(str(rng.randrange(n)) for _ in range(n)).encode()) for _ in range(2))
        b = jaccard_join.np.unique(jaccard_join.np.concatenate([a[: int(len(a) * 0.9)], b[: len(b) // 20]]))
        if 7 * len(jaccard_join.np.intersect1d(a, b)) >= 3 * (len(a) + len(b)):
            assert jaccard_join.could_link(jaccard_join.Point(jaccard_join.point(a)), jaccard_join.Point(jaccard_join.point(b)))


def test_components(spark):
    rng = random.Random(6)
    links = [(i, i + 1) for i in range(30)] + [(100, x) for x in range(101, 140)] + [(200 + rng.randrange(50), 200 + rng.randrange(50)) for _ in range(40)]
    comp = {x: x for e in links for x in e}
    for _ in comp:
        for a, b in links:
            comp[a] = comp[b] = min(comp[a], comp[b])
    got = {r.node: r.comp for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert all(got[x] == c for x, c in comp.items() if x in got)
    assert {x for a, b in links if a != b for x in (a, b)} == set(got)


# decontamination

def plain_words(t):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


@pytest.mark.parametrize("block", [500_000, 15])
def test_decontamination(spark, mixed, block, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    passage = next(t for t in mixed if t and len(t.split()) > 60)
    items = [(1, " ".join(passage.split()[5:30]).upper()), (2, "a b"), (3, ""), (4, None), (None, passage), (10, passage[-80:] + "!"), (1, "zz yy")]
    found = by_id(decontamination.decontaminate(documents(spark, mixed), spark.createDataFrame(items, "item_id long, text string")))
    for i, t in enumerate(mixed):
        w, hit, names = plain_words(t), set(), set()
        for name, text in items:
            v = plain_words(text) if name is not None else []
            n = min(10, len(v))
            for x in {tuple(v[k : k + n]) for k in range(len(v) - n + 1)} if n else ():
                for k in range(len(w) - n + 1):
                    if tuple(w[k : k + n]) == x:
                        hit.update(range(k, k + n))
                        names.add(str(name))
        r = found[i]
        assert (r.n_words, sum(s.end - s.start for s in r.spans), r.items) == (len(w), len(hit), sorted(names))
    assert any(r.items for r in found.values())
    left = {r.doc_id for r in decontamination.drop_contaminated(documents(spark, mixed), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert left == {i for i, r in found.items() if not r.items}


@pytest.mark.parametrize(("block", "vocabulary"), [(500_000, 1_000_000), (12, 1_000_000), (12, 3)])
def test_decontamination_of_rows_without_id_and_repeated_ones(spark, block, vocabulary, monkeypatch):
    monkeypatch.setattr(decontamination, "BLOCK_WORDS", block)
    monkeypatch.setattr(decontamination, "VOCABULARY", vocabulary)
    long = " ".join(f"w{k}" for k in range(60))  # an item of several blocks
    items = spark.createDataFrame([("a", long), ("b", "one two three"), ("c", " ".join(f"v{k}" for k in range(11)))], "item_id string, text string")
    part = " ".join(f"w{k}" for k in range(7, 40))
    texts = [(None, part), (None, "one two three v0"), (4, part), (4, part), (4, "clean"), (5, part + " x one two three"), (6, " ".join(f"v{k}" for k in range(10)))]
    rows = Counter((r.doc_id, r.n_words, tuple((s.start, s.end) for s in r.spans), tuple(r["items"])) for r in decontamination.decontaminate(documents(spark, texts), items).collect())
    assert rows == Counter([
        (None, 33, ((0, 33),), ("a",)), (None, 4, ((0, 3),), ("b",)), (4, 33, ((0, 33),), ("a",)), (4, 33, ((0, 33),), ("a",)), (4, 1, (), ()), (5, 37, ((0, 33), (34, 37)), ("a", "b")),
        (6, 10, ((0, 10),), ("c",))])


def test_proximity(spark):
    got = decontamination.proximity(documents(spark, ["a x y b", "b a", "a x x x x b", None]), ["a b", "nothing b"], 4).collect()
    assert sorted((r.doc_id, r.query) for r in got) == [(0, "a b"), (1, "a b")]


def test_empty_benchmark(spark):
    got = decontamination.decontaminate(documents(spark, ["a b"]), spark.createDataFrame([], "item_id long, text string")).first()
    assert (got.n_words, got.spans, got.items) == (2, [], [])


# suffix dedup

def plain_suffix(texts):
    data = [(t or "").encode() for t in texts]
    seen = Counter(b[p : p + 200] for b in data for p in range(len(b) - 199))
    out = []
    for b in data:
        gone = bytearray(len(b))
        for p in range(len(b) - 199):
            if seen[b[p : p + 200]] > 1:
                gone[p : p + 200] = b"\1" * 200
        out.append((len(b), sum(gone), len([x for x in bytes(gone).split(b"\0") if x]), bytes(x for x, g in zip(b, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("group", [50_000, 1])
def test_suffix(spark, mixed, group, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "GROUP", group)
    rng = random.Random(8)
    make = lambda n: "".join(rng.choices("abcdefgh é", k=n))
    p, q, z = make(230), make(199), make(400)
    texts = [t for t in mixed if len(t or "") < 20_000] + [p + make(50), make(60) + p, make(10) + q, make(20) + q, "a" * 700, "ab" * 300, z, z, make(5) + z[:250] + make(7) + z[150:] + p[10:220], p[:215] + p[15:]]
    texts += [make(rng.randint(0, 40)) + p[rng.randint(0, 15) :] + make(rng.randint(0, 30)) for _ in range(40)]
    got = by_id(suffix_dedup.suffix_dedup(documents(spark, texts)))
    want = plain_suffix(texts)
    assert [(got[i].n_bytes, got[i].n_bytes - len(got[i].kept), len(got[i].spans), bytes(got[i].kept)) for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 5000


def test_suffix_of_rows_without_id_and_texts_in_pieces(spark, monkeypatch):
    rng = random.Random(15)
    p = "".join(rng.choices("abcdefgh ", k=300))
    texts = [(None, p), (3, p + "x"), (3, "y" + p), (None, None), (7, "z" * 250), (7, "q" * 100)]
    got = Counter((r.doc_id, r.n_bytes, bytes(r.kept)) for r in suffix_dedup.suffix_dedup(documents(spark, texts)).collect())
    assert got == Counter([(i, n, kept) for (i, _), (n, _, _, kept) in zip(texts, plain_suffix([t for _, t in texts]), strict=True)])
    long = bytes(rng.choices(b"abcdefgh ", k=9000))
    whole = suffix_dedup.anchors(long)
    monkeypatch.setattr(suffix_dedup, "PLACE", 10)  # pieces of a thousand places
    pieces = suffix_dedup.anchors(long)
    for _, _, place, first, last in (whole, pieces):  # every string has one anchor, inside of it; first and last are distances
        assert sorted(x for p, a, b in zip(place, first, last, strict=True) for x in range(p - a, p - b + 1)) == list(range(len(long) - 199))
        assert ((last >= 0) & (first + suffix_dedup.K <= 200)).all()


def test_suffix_texts_whose_hashes_clash(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_tid", lambda text, clashes: suffix_dedup.F.when(suffix_dedup.F.lit(5).isin(clashes or [0]), suffix_dedup._other(text)).otherwise(suffix_dedup.F.lit(5).cast("long")))
    rng = random.Random(16)
    p = "".join(rng.choices("abcdefgh ", k=300))
    texts = [p + "x", "y" + p, "".join(rng.choices("abcdefgh ", k=400)), "short"]
    got = by_id(suffix_dedup.suffix_dedup(documents(spark, texts)))
    assert [bytes(got[i].kept) for i in range(4)] == [w[3] for w in plain_suffix(texts)]


# line dedup

def test_lines(spark):
    def html(*x):
        return "<html>" + "".join(f"<p class='x'>{y}</p>" for y in x) + "<br/></html>"

    pages = [(i, f"https://u@A.example:80/p{i}", html("Menu", f"own {i}", "<b>Menu</b>")) for i in range(6)] + [(10, "http://b.example", html("Menu", "x")), (11, None, html("q")), (12, "?", None), (None, "http://a.example/", "Menu\nown null<!--\n<p>-->tail")]
    got = {r.page_id: r for r in line_dedup.line_dedup(spark.createDataFrame([(*p, "h") for p in pages], "page_id long, url string, html string, host string")).collect()}
    assert [got[i].kept for i in range(6)] == [[f"own {i}"] for i in range(6)]
    assert (got[None].kept, got[None].host) == (["own null", "tail"], "a.example")
    assert (got[10].kept, got[11].kept, got[12].kept) == (["Menu", "x"], ["q"], [])


def test_lines_of_hosts_with_few_pages(spark):
    rows = [(1, "http://one.example/", "Only\nOnly"), (2, "http://two.example/a", "Menu\nx"), (3, "http://two.example/b", "Menu\ny"), (4, "http://two.example/b", "z")]
    rows += [(5 + k, "http://ten.example/", f"l{k}\nl{k % 7}\nshared" if k < 3 else f"l{k}") for k in range(10)]  # a line on just the ratio of the pages stays
    got = {r.page_id: r.kept for r in line_dedup.line_dedup(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert [got[i] for i in (1, 2, 3, 4)] == [["Only", "Only"], ["x"], ["y"], ["z"]]
    assert got[5] == ["l0", "l0", "shared"]


def test_lines_that_never_end(spark):
    html = ["<p " * 60_000, "<!--" * 60_000, "<a " * 60_000 + ">", " " * 100_000 + "x" + " " * 100_000 + "y", "a<!-->b<p>c<!-- d --><!--e<br>f<q", None, "<p>a</p" + "><" * 50_000]
    began = time.time()
    rows = spark.createDataFrame(list(enumerate(html)), "page_id long, html string").select("page_id", line_dedup.lines(line_dedup.F.col("html")).alias("x")).orderBy("page_id").collect()
    assert time.time() - began < 15
    assert rows[0].x == [html[0].strip()] and rows[1].x == [html[1]] and rows[2].x == [] and rows[5].x == []
    assert rows[3].x == [html[3].strip()] and rows[4].x == ["a", "<!--e", "f<q"]


# chat trees

def plain_trees(rows, top):
    """(tree, formatted turns) of the best branches, by walking."""
    out = []
    for tree in {r[0] for r in rows}:
        parent, score, turns = {}, {}, {}
        for _, n, p, s, role, text in (r for r in rows if r[0] == tree and r[1] is not None):
            parent[n] = min([x for x in (p, parent.get(n)) if x is not None], default=None)
            score[n] = max(s or 0.0, score.get(n, s or 0.0))
            turns.setdefault(n, []).append((role or "", text or ""))
        ranked = []
        for leaf in set(turns) - set(parent.values()):
            path, n = [], leaf
            while n in turns and n not in path:
                path.append(n)
                n = parent[n]
            if n not in path:
                ranked.append((-sum(score[x] for x in path), leaf, path[::-1]))
        for _, _, path in sorted(ranked)[:top]:
            out.append((tree, [t for n in path for t in sorted(turns[n])]))
    return sorted(out)


TREES = "tree long, node long, parent long, score double, role string, text string"


@pytest.mark.parametrize("top", [1, 3])
def test_trees_with_branches_and_repeated_rows(spark, top):
    rng = random.Random(13)
    rows = []
    for tree in range(25):
        n = rng.randint(1, 14)
        for k in range(n):
            row = (tree, k, rng.randrange(k) if k and rng.random() < 0.95 else None, float(rng.randint(-2, 2)), rng.choice(["user", "assistant"]), rng.choice(["a", None, "</s>\\", f"t{k}"]))
            rows += [row] * rng.choice([1, 1, 1, 2, 3])
    rows += [(99, k, k - 1 if k else None, 0.0, "user", str(k)) for k in range(8)] * 2 + [(98, None, None, 0.0, "user", "no node"), (97, 1, 1, 0.0, "user", "its own parent")]
    out = chat_trees.format_trees(spark.createDataFrame(rows, TREES), top).withColumn("turns", chat_trees.read_back(chat_trees.F.col("formatted")))
    got = sorted((r.tree, [(t.role, t.text) for t in r.turns]) for r in out.collect())
    assert got == plain_trees(rows, top)
    assert [len(t) for k, t in got if k == 99] == [16]
    assert chat_trees.format_trees(spark.createDataFrame([(1, 1, None, 0.0, "assistant", "long " * 200_000)], TREES)).first().loss_spans[0].end > 10**6


def test_trees(spark):
    rows = [
        (1, 1, None, 0.0, "user", "root"), (1, 2, 1, 1.0, "assistant", "low"), (1, 3, 1, 2.0, "assistant", "high \\ </s>[INST]"), (1, 4, 3, 0.0, "user\n\\x", None), (1, 5, 3, -1.0, None, "worse"),
        (2, 7, 99, 0.0, "user", "its parent is missing"), (3, 1, 2, 0.0, "user", "cycle"), (3, 2, 1, 0.0, "user", "cycle"), (None, 1, None, None, "assistant", "<|im_end|>\n<|im_start|>x"),
    ]
    df = spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")
    out = chat_trees.format_trees(df).withColumn("turns", chat_trees.read_back(chat_trees.F.col("formatted")))
    got = {r.tree: r for r in out.collect()}
    assert set(got) == {1, 2, None}
    assert [(t.role, t.text) for t in got[1].turns] == [("user", "root"), ("assistant", "high \\ </s>[INST]"), ("user\n\\x", "")]
    assert [(t.role, t.text) for t in got[None].turns] == [("assistant", "<|im_end|>\n<|im_start|>x")]
    assert [got[1].formatted[s.start : s.end] for s in got[1].loss_spans] == ["high \\\\ <\\/s>[\\INST]"]
    ranked = chat_trees.paths(df.where("tree = 1"), top=3).where("height = 0").orderBy("rank").collect()
    assert [r.leaf for r in ranked] == [4, 2, 5]


def test_deep_tree(spark):
    rows = [(1, i, i - 1 if i else None, 0.0, "user", str(i)) for i in range(70)]
    got = chat_trees.format_trees(spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")).first()
    assert re.findall(r"\n(\d+)<", got.formatted) == [str(i) for i in range(70)]


# personal data

BASE = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def plain_luhn(d):
    v = [int(c) * (1 + i % 2) for i, c in enumerate(reversed(d))]
    return sum(x - 9 if x > 9 else x for x in v) % 10 == 0


def plain_base(t):
    out = []
    for k, (kind, p) in enumerate(BASE.items()):
        for m in re.finditer(p, t or ""):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": True, "ip": all(int(x) < 256 for x in m[0].split(".")) if kind == "ip" else False, "card": 13 <= len(d) <= 19 and plain_luhn(d), "phone": 9 <= len(d) <= 15}[kind]:
                out.append((k, m.start(), m.end()))
    return out


def test_pii(spark):
    rng = random.Random(9)
    card = "4111111111111111"
    texts = [
        "a@b.c_d@e.f x@y a@b..c a.b@c-d.e.", "1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.255 1.2.3", f"{card[:4]} {card[4:8]} {card[8:12]} {card[12:]}-2 {card}", "+1 (2) 3-4 +123456789 +1 (755) 555-9729",
        None, "", "😀 a@b.co 😀 +49 30 1234567", "a" * 20000 + "@" + "b" * 20000, "1." * 5000, "1 " * 5000, "+" + " " * 5000 + "1", "@".join(["x.y"] * 500)]
    texts += ["".join(rng.choices(["1", "12", "@", ".", "+", "-", " ", "(", ")", "a", "b.c", card, "é"], k=rng.randint(1, 25))) for _ in range(200)]
    got = by_id(pii.personal_data(documents(spark, texts)))
    for i, t in enumerate(texts):
        assert [tuple(s) for s in got[i].base] == plain_base(t), t
        assert {tuple(s) for s in got[i].base} <= {tuple(s) for s in got[i].spans}
    texts = [f"pay {card} or call +1 (755) 555-97{i % 90:02d} now" for i in range(300)] + [f"pay 12 {card} now", "call (755) 555-9729 now", f"pay {card[:-1]}2 now"] * 2
    got = by_id(pii.personal_data(documents(spark, texts)))
    assert [[tuple(s) for s in got[i].spans] for i in (300, 301, 302)] == [[(2, 7, 23)], [(3, 5, 19)], []]  # what the base swallows or misses
    df = pii.personal_data(documents(spark, ["x a@b.co, +1 (755) 555-9729!"])).join(documents(spark, ["x a@b.co, +1 (755) 555-9729!"]).select("doc_id", "text"), "doc_id")
    assert df.select(pii.redact(pii.F.col("text"), pii.F.col("spans")).alias("x")).first().x == "x [EMAIL], [PHONE]!"


@pytest.mark.parametrize("bad", [0, 90])
def test_pii_adds_forms_that_the_base_often_misses(spark, bad):
    card = "4111111111111112"  # fails its check
    texts = [f"call {sign}(755) 555-97{i:02d} now, mail ann@host{i}.com" for i in range(80) for sign in ("+1 ", "")]
    forms = [("ask 555-123-4567.", "555-123-4567", 3), ("ask john (at) host.com. Then", "john (at) host.com", 0), ("ask john [at] host [dot] com", "john [at] host [dot] com", 0)]
    n = len(texts)
    texts += [f[0] for f in forms] * 30 + [f"pay {card} or look (at) home. Then 300.1.2.3"] * bad
    got = by_id(pii.personal_data(documents(spark, texts)))
    for i in range(1, n, 2):
        assert (3, 5, 19) in [tuple(s) for s in got[i].spans]
    for i, (text, form, kind) in enumerate(forms * 30):
        assert [tuple(s) for s in got[n + i].spans] == [(kind, text.index(form), text.index(form) + len(form))]
    assert all(not got[i].spans for i in range(n + 90, len(texts)))


def test_pii_finds_planted_items_by_their_context(spark):
    """Truth is what was planted: real items in forms that the base misses, and chance numbers in the same form elsewhere."""
    rng = random.Random(14)

    def card(real):
        d = [rng.randrange(10) for _ in range(15)]
        for last in range(10):
            x = "".join(map(str, [*d, last]))
            if plain_luhn(x) == real:
                return x

    texts, planted = [], []
    for _ in range(400):
        number = f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randrange(10000):04d}"
        mail = f"{rng.choice(['ann', 'bob', 'eve'])}{rng.randrange(99)} (at) host{rng.randrange(9)}.com"
        real = card(True)
        number_of_card = "-".join(real[i : i + 4] for i in range(0, 16, 4))
        for text, item, kind in (
            (f"tel: {number} thanks", number, 3), (f"mail {mail} now", mail, 0), (f"visa 7 {number_of_card} ok", number_of_card, 2),
            (f"id#{rng.randint(100, 999)}-{rng.randrange(1000):03d}-{rng.randrange(10000):04d}", None, 3), (f"serial x{card(rng.random() < 0.1)}y", None, 2),
        ):
            texts.append(text)
            planted.append((kind, text.index(item), text.index(item) + len(item)) if item else None)
    got = by_id(pii.personal_data(documents(spark, texts)))
    found = [[tuple(s) for s in got[i].spans] for i in range(len(texts))]
    assert sum(p in f for p, f in zip(planted, found, strict=True) if p) >= 0.9 * sum(p is not None for p in planted)
    added = sum(len([s for s in got[i].spans if s not in got[i].base]) for i in range(len(texts)))
    assert sum(p in f for p, f in zip(planted, found, strict=True) if p) >= 0.9 * added


# learnt operators

def test_toxicity(spark):
    rng = random.Random(10)
    words = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 6))) for _ in range(500)]
    texts, toxic = [], []
    for i in range(900):
        t = rng.choices(words, k=rng.randint(20, 120))
        toxic.append(int(i % 8 == 0))
        if toxic[-1]:
            for _ in range(1 + len(t) // 15):
                t[rng.randrange(len(t))] = rng.choice(["vileword", "nastyone", "vileness"])
        texts.append(" ".join(t))
    docs = documents(spark, [*texts, None, "", "word " * 30_000])
    labels = spark.createDataFrame([(i, 1, x, "z") for i, x in enumerate(toxic) if i % 2 == 0] + [(None, 1, 1, "z"), (3, 0, None, "z")], "doc_id long, quality int, toxic int, text string")
    got = by_id(toxicity.toxicity(docs, labels))
    assert len(got) == 903
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 3 == 1) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    held = [i for i in range(900) if got[i].held_out]
    assert sum(got[i].predicted == toxic[i] for i in held) / len(held) > 0.97
    assert got[900].score == got[901].score < 0.7
    assert {r.doc_id for r in toxicity.reject_toxic(docs, labels).collect()} == {i for i, r in got.items() if not r.predicted}
    assert {r.score for r in toxicity.toxicity(docs, labels.where("toxic = 0")).collect()} == {0.0}


def test_nnpu_does_not_learn_that_all_unlabelled_is_negative():
    rng = toxicity.np.random.default_rng(0)
    p, n = rng.normal(2, 1, (400, 1)), rng.normal(-2, 1, (700, 1))
    w = toxicity.fit_nnpu(p[:100], toxicity.np.vstack([p[100:], n]), 0.3)
    assert ((p[:, 0] * w[0] + w[1]) > 0).mean() > 0.85 and ((n[:, 0] * w[0] + w[1]) < 0).mean() > 0.9


def test_language(spark):
    rng = random.Random(11)
    stems = {"aa": "abcde", "bb": "cdefg", "cc": "éöüab"}
    vocabulary = {x: ["".join(rng.choices(s, k=rng.randint(2, 7))) for _ in range(200)] for x, s in stems.items()}
    texts, langs = [], {}
    for i in range(300):
        lang = rng.choice(list(stems))
        langs[i] = lang
        texts.append(" ".join(rng.choices(vocabulary[lang], k=rng.randint(15, 40))).capitalize() + ", 12.")
    texts += [None, "", "12 .. ²", "unseenwordonly " + "".join(rng.choices("éöü", k=9)), "中文"]
    got = by_id(language_id.language_id(documents(spark, texts, langs)))
    held = [i for i in range(300) if got[i].held_out]
    assert all(got[i].held_out == (zlib.crc32(str(i).encode()) % 4 == 2) for i in got)
    assert sum(got[i].lang_pred == langs[i] for i in held) / len(held) > 0.97
    assert [(got[i].lang_pred, got[i].score) for i in (300, 301, 302)] == [("und", 0.0)] * 3
    assert got[304].lang_pred in stems
    assert {r.lang_pred for r in language_id.language_id(documents(spark, ["abc"])).collect()} == {"und"}


def test_learnt_operators_pick_rows_they_can_use(spark, monkeypatch):
    """Ids of the smallest hashes whose texts are null or too long do not use up the sample; repeated rows are learnt from once."""
    rng = random.Random(17)
    vocabulary = {x: ["".join(rng.choices(s, k=rng.randint(3, 7))) for _ in range(80)] for x, s in (("aa", "abcde"), ("bb", "fghij"), ("cc", "klmno"))}
    monkeypatch.setattr(language_id, "SAMPLE", 12)
    monkeypatch.setattr(language_id, "SAMPLE_CHARS", 400)
    texts, langs = [], {}
    for i in range(240):
        lang = ("aa", "bb", "cc")[i % 3]
        langs[i] = lang
        words = rng.choices(vocabulary[lang], k=200 if lang == "cc" or i % 2 else 20)  # all of cc and half of the rest are too long
        texts.append((i, None if i % 12 == 0 else " ".join(words)))
    texts += [texts[1]] * 60
    docs = documents(spark, texts, langs)
    model = language_id.learn(docs)
    assert model.langs == ["aa", "bb", "cc"]
    got = Counter((r.doc_id, r.lang_pred) for r in language_id.language_id(docs).collect())
    assert sum(got.values()) == len(texts) and got[1, "bb"] == 61
    assert all(p == langs[i] for (i, p), _ in got.items() if i % 12)
    monkeypatch.setattr(toxicity, "SAMPLE_UNLABELLED", 30)
    monkeypatch.setattr(toxicity, "SAMPLE_CHARS", 400)
    seen = []
    monkeypatch.setattr(toxicity, "fit", lambda p, u, prior: seen.append((p, u, prior)) or toxicity.Model({}, toxicity.np.zeros(0), toxicity.np.ones(0), None))
    toxicity.learn(docs, spark.createDataFrame([(i, int(i % 4 == 1)) for i in range(240)] * 2, "doc_id long, toxic int"))
    (positive, unlabelled, prior), short = seen[0], {t for i, t in texts if t and len(t) <= 400 and zlib.crc32(str(i).encode()) % 3 != 1}
    assert len(unlabelled) == 30 and set(unlabelled) <= short and len(set(unlabelled)) == 30
    assert set(positive) == {t for i, t in texts if t in short and i % 4 == 1} and len(positive) == len(set(positive)) and 0.15 < prior < 0.35


# all

def test_empty_tables(spark):
    docs = documents(spark, ["x"]).where("false")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    benchmark = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    path = byte_bpe.public_vocabulary()
    for df in (
        toxicity.toxicity(docs, labels), decontamination.decontaminate(docs, benchmark), jaccard_join.jaccard_groups(docs), exact_dedup.exact_groups(docs), language_id.language_id(docs), suffix_dedup.suffix_dedup(docs),
        pii.personal_data(docs), byte_bpe.encode(docs, *path), line_dedup.line_dedup(spark.createDataFrame([], "page_id long, url string, html string")),
        chat_trees.format_trees(spark.createDataFrame([], "tree long, node long, parent long, score double, role string, text string")),
    ):
        assert df.count() == 0
