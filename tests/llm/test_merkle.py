"""Merkle manifests against trees built at once from sorted leaves."""

import zlib
from hashlib import sha256

import pytest

from lexigrid.llm import merkle


def h(*digests):
    return sha256("".join(digests).encode()).hexdigest()


def entry(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf_of(row, more=0):
    doc_id, text, lang, source, n = row
    n = None if n is None else n + more
    return sha256("".join(map(entry, (doc_id, source, lang, n, text))).encode()).hexdigest()


def levels_of(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][k : k + 2]) for k in range(0, len(out[-1]), 2)])
    return out


def siblings(levels, at):
    for level in levels[:-1]:
        pair = level[at // 2 * 2 : at // 2 * 2 + 2]
        yield at % 2, [x for k, x in enumerate(pair) if k != at % 2]
        at //= 2


def brute(rows):
    langs = sorted({r[2] for r in rows}, key=lambda x: ("" if x is None else "=" + x).encode())
    trees = {}
    for lang in langs:
        own = sorted((r for r in rows if r[2] == lang), key=lambda r: (r[0] is not None, r[0] or 0, leaf_of(r)))
        trees[lang] = own, levels_of([leaf_of(r) for r in own])
    top = levels_of([trees[x][1][-1][0] for x in langs])
    out = []
    for k, lang in enumerate(langs):
        own, levels = trees[lang]
        for at, r in enumerate(own):
            way = [*siblings(levels, at), *siblings(top, k)]
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            node = leaf_of(r, int(tampered))
            for right, others in way:
                node = h(*([*others, node] if right else [node, *others]))
            out.append((r[0], leaf_of(r), levels[-1][0], top[-1][0], h(*(x for _, others in way for x in others)), node, node == top[-1][0]))
    return out


def got(docs, **more):
    cols = "doc_id leaf subroot root proof_sha256 folded_root verified".split()
    return [tuple(r) for r in merkle.manifest(docs, **more).select(cols).collect()]


def known(rows):
    return sorted(rows, key=str)


def full(rows):
    return [(r.doc_id, r.text, r.lang, r.source, r.n_chars) for r in rows.collect()]


@pytest.mark.parametrize("height", [1, 2, 10])
def test_against_whole_trees(docs_of, height):
    # a hot language, a lone one, null and empty ones, sizes that leave nodes without siblings
    docs = docs_of([(k, f"text {k} é", "en" if k % 3 else ["de", None, "", "fr", "ü"][k // 3 % 5], "s") for k in range(77)] + [(900, "x", "zz", None)])
    want = brute(full(docs))
    rows = got(docs, height=height)
    assert known(rows) == known(want)
    assert {r[0] for r in rows if not r[-1]} == {r.doc_id for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 7 == 0}


def test_odd_rows(odd):
    assert known(got(odd)) == known(brute(full(odd)))
    assert known(got(odd, height=1)) == known(brute(full(odd)))
    assert got(odd.limit(0)) == []


def test_repeated_rows_and_null_counts(spark):
    rows = [(5, "same", "en", "s", 4)] * 40 + [(k, None, None, None, None) for k in range(20)] + [(None, None, None, None, 2**63 - 1)] * 3 \
        + [(8, "most", "en", "s", 2**63 - 1)]
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, at int, g string")
    assert known(got(docs, height=2)) == known(brute(rows))
    # a null count stays null, so tampering changes nothing
    assert all(r[-1] for r in got(docs) if r[0] is not None and r[0] < 20 and r[0] not in (5, 8))


def test_one_row(docs_of):
    (row,) = got(docs_of([(1, "only", "en", "s")]))
    assert row[1] == row[2] == row[3] == row[5] and row[4] == sha256(b"").hexdigest() and row[6]


def test_witnesses_grow_with_each_append():
    """After any number of appends, the frontier closes to the tree of what has been appended."""
    leaves = [sha256(bytes([k])).digest() for k in range(37)]
    for n in range(1, len(leaves) + 1):
        frontier = merkle.Frontier()
        for leaf in leaves[:n]:
            frontier.append(leaf)
        root, paths = frontier.close()
        assert root.hex() == levels_of([x.hex() for x in leaves[:n]])[-1][0] and len(paths) == n
        assert all(merkle.fold(leaf, [(k, n)], b"".join(path)) == root for k, (leaf, path) in enumerate(zip(leaves, paths)))
