import hashlib
import random
import zlib

import pytest

from tidemill.llm import merkle

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def said(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def tree(nodes):
    """Levels by the definition, and each leaf's (siblings before, after) from the bottom up."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([h(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    paths = []
    for at in range(len(nodes)):
        path = []
        for level in levels[:-1]:
            run = at // 3 * 3
            path.append((level[run:at], level[at + 1 : run + 3]))
            at //= 3
        paths.append(path)
    return levels[-1][0], paths


def slow(rows):
    groups = {}
    for doc_id, text, lang, source, n_chars in rows:
        make = lambda t: h(*(said(x) for x in (doc_id, source, lang, n_chars, t)))  # noqa: E731, B023
        hit = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0
        now = make(text.replace("\n", "") if hit and text is not None else text)
        groups.setdefault(source, []).append((doc_id is not None, doc_id or 0, make(text), doc_id, now))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for leaves in groups.values():
        leaves.sort()
    inner = {name: tree([x[2] for x in groups[name]]) for name in names}
    root, above = tree([inner[name][0] for name in names]) if names else (None, [])
    out = []
    for name, outer in zip(names, above, strict=True):
        for (_, _, leaf, doc_id, now), path in zip(groups[name], inner[name][1], strict=True):
            for left, right in path + outer:
                now = h(*left, now, *right)
            proof = h(*(x for left, right in path + outer for x in left + right))
            out.append((doc_id, leaf, inner[name][0], root, proof, now))
    return sorted(out, key=repr)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(3)
    out = [(i, rng.choice(["a\nb", "", "é\n\n", "plain", None]), rng.choice(["en", None]), rng.choice(["big"] * 4 + ["b", "é", "Z", None]), i % 7 or None) for i in range(300)]
    out += [(None, "no id\n", "en", "big", 1), (5, "again\n", "en", "b", 2), (5, "again\n", "en", "b", 2), (900, "z" * 200_000 + "\n", "de", "alone", 3)]
    return out + [(7, "copy\n", "en", "copies", 0)] * 90


@pytest.mark.parametrize("width", [3, 9, 729])
def test_manifest_equals_the_definition(spark, rows, width):
    docs = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as id", "'x' as node", "2 as pos", "3 as grp").repartition(3)
    got = sorted((tuple(r) for r in merkle.manifest(merkle.document_leaves(docs), width=width).collect()), key=repr)
    assert got == slow(rows)


def test_manifest_of_little(spark):
    assert merkle.manifest(merkle.document_leaves(spark.createDataFrame([], SCHEMA))).count() == 0
    for rows in ([(1, "x\n", None, None, None)], [(1, "x\n", "en", "a", 2), (2, None, "en", "b", 0)], [(1, "x", "en", "a", 1), (2, "y", "en", "a", 1)]):
        got = [tuple(r) for r in merkle.manifest(merkle.document_leaves(spark.createDataFrame(rows, SCHEMA))).collect()]
        assert sorted(got, key=repr) == slow(rows)
