"""Queries without SQL over whole tables, held against rules that do not use the library's splitters."""

import os
import re
from collections import defaultdict

import pytest

from kbspark.plans import registry
from kbspark.plans.base import corpus, lines

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


def bare(text):
    return re.sub(r"\s", "", text or "")


def chunks_of(rows, key):
    found = defaultdict(list)
    for r in rows:
        found[r[key]].append((r["seq"], r["content"]))
    assert all([s for s, _ in sorted(xs)] == list(range(len(xs))) for xs in found.values())
    return {k: [c for _, c in sorted(xs)] for k, xs in found.items()}


def covers(chunks, text):
    """Every chunk stands in the text, at its last place that leaves nothing uncovered before it, and the last one ends it."""
    end = 0
    for chunk in map(bare, chunks):
        place = text.rfind(chunk, 0, end + len(chunk))
        if place < 0:
            return False
        end = max(end, place + len(chunk))
    return end == len(text)


@pytest.fixture(scope="module")
def texts(spark):
    return {r["doc_id"]: r["text"] for r in corpus(spark, SF).collect()}


def test_split_characters(spark, texts):
    found = chunks_of(registry.queries()["split_characters"](spark, SF).collect(), "doc_id")
    assert {k: bare("".join(v)) for k, v in found.items()} == {k: bare(t) for k, t in texts.items() if bare(t)}
    assert all(0 < len(c) <= 200 and c == c.strip() and "\n\n" not in c for v in found.values() for c in v)


def test_split_recursive(spark, texts):
    found = chunks_of(registry.queries()["split_recursive"](spark, SF).collect(), "doc_id")
    assert set(found) == {k for k, t in texts.items() if bare(t)}
    assert all(covers(v, bare(texts[k])) for k, v in found.items())


def test_split_sections(spark, texts):
    found = chunks_of(registry.queries()["split_sections"](spark, SF).collect(), "doc_id")
    numbered = {k: t.replace("\n", "\n一、") for k, t in texts.items() if t is not None}
    assert set(found) == {k for k, t in numbered.items() if bare(t)}
    for k, v in found.items():
        assert covers(v, bare(numbered[k]))
        # a chunk over the size is one section, which has no other heading in it
        assert all(len(re.findall("一、.", c)) <= 1 for c in v if len(c) > 400)


def test_small_to_big(spark):
    rows = registry.queries()["small_to_big"](spark, SF).collect()
    parents = defaultdict(list)
    for r in rows:
        parents[r["kb_name"], r["file"], r["parent_id"]].append((r["seq"], r["content"]))
    joined = sorted((kb, file, bare("".join(c for _, c in sorted(xs)))) for (kb, file, _), xs in parents.items())
    assert joined == sorted((r["kb_name"], r["file"], bare(r["content"])) for r in lines(spark, SF).collect() if bare(r["content"]))
    assert all(len(r["content"]) <= 100 for r in rows) and len({r["chunk_id"] for r in rows}) == len(rows)


def test_chunk_corpus(spark):
    rows = registry.queries()["chunk_corpus"](spark, SF).collect()
    big = {r["chunk_id"]: r for r in rows if r["parent_id"] is None}
    children = defaultdict(list)
    for r in rows:
        if r["parent_id"] is not None:
            children[r["parent_id"]].append((r["seq"], r["content"]))
    assert {k: bare("".join(c for _, c in sorted(xs))) for k, xs in children.items()} == {k: bare(r["content"]) for k, r in big.items()}
    found = chunks_of(big.values(), "file")
    # merging joins the recursive splitter's chunks, whose overlaps stay, and changes no text
    names = {r["doc_id"]: r["file"] for r in corpus(spark, SF).collect()}
    parts = chunks_of(registry.queries()["split_recursive"](spark, SF).collect(), "doc_id")
    assert {k: bare("".join(v)) for k, v in found.items()} == {names[k]: bare("".join(v)) for k, v in parts.items()}
    # merging leaves a chunk under 80 characters only where it is a file's only one
    assert all(len(c) >= 80 for v in found.values() if len(v) > 1 for c in v)


def test_stream_index(spark):
    """A file that arrives once has the chunks of chunk_corpus; one that arrives twice has those of its last text alone."""
    found = chunks_of(registry.queries()["stream_index"](spark, SF).collect(), "file")
    once = chunks_of(registry.queries()["chunk_corpus"](spark, SF).where("parent_id IS NULL").collect(), "file")
    docs = corpus(spark, SF).collect()
    again = {r["file"]: bare(r["text"]) + "Secondarrival." for r in docs if r["doc_id"] % 5 == 0}
    assert {k: v for k, v in found.items() if k not in again} == {k: v for k, v in once.items() if k not in again}
    for k, text in again.items():
        joined = bare("".join(found[k]))
        assert joined.endswith("Secondarrival.") and joined[:30] == text[:30] and len(joined) >= len(text)
        assert not any("Second arrival." in c for c in found[k][:-2])
