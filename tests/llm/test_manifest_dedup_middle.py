"""Merkle manifest, exact duplicates and fill-in-middle against plain loops."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from framewarden.llm import cuckoo, exact_dedup, fill_in_middle, merkle_manifest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def frame(spark, rows):
    return spark.createDataFrame(rows, DOCS)


def awkward(n, sources, seed=0):
    pick = random.Random(seed)
    return [(
        pick.choice([i, i, 5, None]), pick.choice([None, "", "x\ny", "\n", f"t{i}\n", "a  b", "<P>", "é" * i]),
        pick.choice([None, "en"]), pick.choice(sources), pick.choice([None, 3]),
    ) for i in range(n)]


def sorted_rows(df, *columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=repr)


# Merkle manifest -----------------------------------------------------------

MANIFEST = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row, text):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (row[0], row[3], row[2], row[4], text)))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 3]) for i in range(0, len(out[-1]), 3)])
    return out


def siblings(tree, at):
    out = []
    for row in tree[:-1]:
        first = at - at % 3
        out.append(("".join(row[first:at]), "".join(row[at + 1 : first + 3])))
        at //= 3
    return out


def plain_manifest(rows):
    by_source = {}
    for row in rows:
        by_source.setdefault(row[3], []).append(row)
    sources = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for s in sources:
        by_source[s].sort(key=lambda r: (r[0] is None, r[0] or 0, leaf(r, r[1])))
        trees[s] = levels([leaf(r, r[1]) for r in by_source[s]])
    top = levels([trees[s][-1][0] for s in sources])
    out = []
    for k, s in enumerate(sources):
        for i, row in enumerate(by_source[s]):
            path = siblings(trees[s], i) + siblings(top, k)
            tampered = row[0] is not None and row[1] is not None and zlib.crc32(str(row[0]).encode()) % 2 == 0
            node = leaf(row, row[1].replace("\n", "") if tampered else row[1])
            for left, right in path:
                node = h(left, node, right)
            out.append((row[0], leaf(row, row[1]), trees[s][-1][0], top[-1][0], h(*(a + b for a, b in path)), node, node == top[-1][0]))
    return sorted(out, key=repr)


@pytest.mark.parametrize(
    ("n", "sources"),
    [(1, ["a"]), (9, ["a"]), (10, ["a"]), (150, [None, "", "é", "a", "b", "z"]), (300, [str(i) for i in range(40)] + ["hot"] * 60)],
)
def test_manifest_equals_a_plain_tree(spark, monkeypatch, n, sources):
    monkeypatch.setattr(merkle_manifest, "LEVELS", 2)
    monkeypatch.setattr(merkle_manifest, "BLOCK", 9)
    rows = awkward(n, sources, n)
    assert sorted_rows(merkle_manifest.manifest(frame(spark, rows)), *MANIFEST) == plain_manifest(rows)


def test_manifest_of_no_rows_and_of_clashing_columns(spark):
    assert merkle_manifest.manifest(frame(spark, [])).collect() == []
    rows = [(i, "a\nb" * 400_000 if i == 3 else "a\nb", "en", "s", 1) for i in range(30)] + [(7, "a", "en", "s", 1)] * 500
    more = frame(spark, rows).selectExpr("*", "1 as pos", "2 as tree", "3 as leaf", "4 as block", "5 as times")
    assert sorted_rows(merkle_manifest.manifest(more), *MANIFEST) == plain_manifest(rows)


def test_versions_copy_only_the_path():
    pool = merkle_manifest.Pool()
    tree = pool.tree([bytes([i]) * 32 for i in range(20)], None)
    base = len(pool.digests)
    copies = pool.version(tree, 13, b"x" * 32)
    assert len(copies) == len(tree) and len(pool.digests) == base + len(tree)
    assert pool.children[copies[1]] == (tree[0][12], copies[0], tree[0][14])
    again = merkle_manifest.Pool().tree([bytes([i]) * 32 if i != 13 else b"x" * 32 for i in range(20)], None)
    fresh = merkle_manifest.Pool()
    again = fresh.tree([bytes([i]) * 32 if i != 13 else b"x" * 32 for i in range(20)], None)
    assert pool.digests[copies[-1]] == fresh.digests[again[-1][0]]
    assert [len(r) for r in merkle_manifest.Pool().tree([b"a"] * 2, 3)] == [2, 1, 1, 1]


# Exact duplicates ----------------------------------------------------------

GROUPS = ("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def plain_groups(rows):
    found = {}
    for row in rows:
        found.setdefault(re.sub(r"[\x20\x09-\x0D]", "", row[1] or ""), []).append((-len(row[1] or ""), row[0] is None, row[0] or 0))
    out = []
    for text, members in found.items():
        members.sort()
        ids = [None if none else doc for _, none, doc in members]
        out += [(doc, ids[0], len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()) for k, doc in enumerate(ids)]
    return sorted(out, key=repr)


def texts(n, seed, start=0):
    pick = random.Random(seed)
    return [(start + i, pick.choice("abcdef") * pick.randint(1, 20) + " \t\n\x0b\x0c\r"[: pick.randint(0, 6)], "en", "s", 1) for i in range(n)]


def test_exact_groups_equal_a_plain_dictionary(spark):
    rows = awkward(200, ["a", None]) + [(i, "copy of\tone text", "en", "s", 1) for i in range(1000, 1400)] + [(9, " q " * 300_000, "", "", 0)]
    more = frame(spark, rows).selectExpr("*", "1 as digest", "2 as row", "3 as kept", "4 as shard")
    assert sorted_rows(exact_dedup.exact_dedup(more), *GROUPS) == plain_groups(rows)
    assert exact_dedup.exact_dedup(frame(spark, [])).collect() == []


@pytest.mark.parametrize("bits", [2, 16])
def test_index_inserts_deletes_and_grows(spark, monkeypatch, bits):
    """Fingerprints of two bits make most look-ups hit; small shards overflow and are dealt anew."""
    monkeypatch.setattr(exact_dedup, "KEYS_A_SHARD", 16)
    rows = texts(300, 1) + [(None, None, None, None, None), (7000, " ", "", "", 0)]
    index = exact_dedup.empty_index(spark, 0, bits)
    for some in (rows[:40], rows[40:41], rows[41:]):
        index = exact_dedup.insert(index, exact_dedup.rows_of(frame(spark, some)))
    assert sorted_rows(exact_dedup.groups(index), *GROUPS) == plain_groups(rows)
    gone = {i for i in range(300) if i % 3} | {9999}
    index = exact_dedup.delete(index, frame(spark, [(i, "", "", "", 0) for i in gone]))
    left = [r for r in rows if r[0] not in gone]
    assert sorted_rows(exact_dedup.groups(index), *GROUPS) == plain_groups(left)
    more = texts(100, 2, 10_000)
    index = exact_dedup.insert(index, exact_dedup.rows_of(frame(spark, more)))
    assert sorted_rows(exact_dedup.groups(index), *GROUPS) == plain_groups(left + more)
    # Every live digest has one place in its filter.
    filled = sum(np.count_nonzero(np.frombuffer(r.slots, dtype=np.uint16)) for r in index.filters.collect())
    assert filled == index.keys.count()


def test_cuckoo_filter_adds_removes_and_overflows():
    pick = random.Random(5)
    keys = [pick.getrandbits(64) for _ in range(3000)]
    full = cuckoo.built(keys)
    assert all(k in full for k in keys)
    assert sum(pick.getrandbits(64) in full for _ in range(10_000)) < 20
    for k in keys[::2]:
        full.remove(k)
    assert all(k in full for k in keys[1::2]) and sum(k in full for k in keys[::2]) < 10
    small = cuckoo.CuckooFilter(8)
    for k in keys[:100]:
        small.add(k)
    assert small.overflowed and all(k in small for k in keys[:100])
    small.remove(small.stash[0])
    with pytest.raises(KeyError):
        cuckoo.CuckooFilter(8).remove(1)


# Fill-in-middle ------------------------------------------------------------

MADE = ("doc_id", "text", "n", "form", "prefix_chars", "middle_chars", "output", "restored")


def plain_middle(doc, text):
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text)
    n = len(tokens)
    digits = hashlib.sha256(f"1:{'' if doc is None else doc}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digits[8 * i : 8 * i + 8], 16) for i in range(4))
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    if not text or any(mark in text for mark in fill_in_middle.MARKS) or h3 % 100 >= 90:
        return doc, text, n, "plain", None, None, text, text
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return doc, text, n, form, len(p), len(m), out, text


def test_middle_equals_plain_slices(spark):
    pick = random.Random(3)
    pieces = ["word", "Z", " ", "\n", "é", "日", "😀", "<", "P>", "<M", ">", "7", "<S>", "\x00"]
    rows = [(pick.choice([i, None, -i]), "".join(pick.choices(pieces[: pick.choice([8, 12, 14])], k=pick.randint(0, 60)))) for i in range(800)]
    rows += [(1, None), (2, ""), (3, "a"), (3, "a"), (4, "ab é" * 500_000), (5, "x" * 3_000_000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "1 as n", "2 as form", "3 as output", "4 as _h0")
    made = fill_in_middle.restore(fill_in_middle.fill_in_middle(df))
    want = [plain_middle(doc, text or "") for doc, text in rows]
    assert sorted_rows(made, *MADE) == sorted(want, key=repr)
    assert {r[3] for r in want} == set(fill_in_middle.FORMS)
    assert fill_in_middle.restore(fill_in_middle.fill_in_middle(df.limit(0))).collect() == []


def test_outputs_of_others_restore_to_null(spark):
    rows = [("psm", "no marks"), ("spm", "<S>a<P>b"), ("psm", "<P>a<S>b<M>c"), ("plain", "<P>x"), (None, "a"), ("odd", "a"), ("psm", None), ("plain", "")]
    got = fill_in_middle.restore(spark.createDataFrame(rows, "form string, output string"))
    assert {(r.form, r.output): r.restored for r in got.collect()} == dict(zip(rows, [None, None, "acb", "<P>x", None, None, None, ""], strict=True))
