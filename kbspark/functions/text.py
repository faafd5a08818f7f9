"""Text splitting on the Python side of a pandas UDF, over offsets of the text.

A splitter cuts a text at the places of its coarsest separator. Neighbouring parts shorter than the
size share chunks; a longer part is cut again by the finer separators, and stays whole if none is
left. All of it works on cut positions; text is sliced out once, when the chunks are known.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Callable
from itertools import pairwise

from kbspark.functions.columns import sentence_pattern

#: Separators of the section-aware splitter, tried in this order.
SECTION_SEPARATORS = (
    r"[\n]\s*[一二三四五六七八九十]+、.+",
    r"[\n]\s*（[一二三四五六七八九十]+）",
    r"0\d\s{1,2}",
    "\n\n",
    "。|！|？",
    r"\n\d\.",
    r"\.\s|\!\s|\?\s",
    r"；|;\s",
    r"，|,\s",
)
#: Separators of the plain character splitter, literal.
CHARACTER_SEPARATORS = ("\n\n", "\n", " ", "")
#: Fixed value: the one rule of the section splitter.
SECTION_RULE = r"[一二三四五六七八九十]+、.+"


def cut_positions(text: str, begin: int, end: int, rules: tuple[str, ...]) -> tuple[list[int], tuple[str, ...]]:
    """Where the first rule that occurs in text[begin:end] cuts it, both ends included, and the finer rules after it.

    A cut stands before each match; the empty rule cuts at every character.
    """
    for k, rule in enumerate(rules):
        if not rule:
            return list(range(begin, end + 1)), ()
        places = {m.start() for m in re.compile(rule).finditer(text, begin, end) if m.end() > m.start()}
        if places:
            return sorted(places | {begin, end}), rules[k + 1 :]
    return [begin, end], ()


def packed_spans(cuts: list[int], size: int, overlap: int) -> list[tuple[int, int]]:
    """Spans of whole parts (between neighbouring cuts, each shorter than the size): as long as the size allows, and each one reaches back over the last parts of the one before as far as `overlap` and its own first new part allow."""
    spans, first, last = [], 0, len(cuts) - 1
    while True:
        upto = bisect_right(cuts, cuts[first] + size) - 1
        spans.append((cuts[first], cuts[upto]))
        if upto == last:
            return spans
        first = max(bisect_left(cuts, cuts[upto] - overlap), bisect_left(cuts, cuts[upto + 1] - size))


def split_by_rules(text: str, rules: tuple[str, ...], size: int, overlap: int) -> list[str]:
    """Chunks of a text, without white space at their ends and without empty lines."""
    spans: list[tuple[int, int]] = []
    todo = [(0, len(text), rules, False)]  # the part to come next is on top
    while todo:
        begin, end, finer, final = todo.pop()
        if final:
            spans.append((begin, end))
            continue
        cuts, rest = cut_positions(text, begin, end, finer)
        found, run = [], [cuts[0]]
        for a, b in pairwise(cuts):
            if b - a < size:
                run.append(b)
                continue
            found += [(x, y, (), True) for x, y in packed_spans(run, size, overlap)] if len(run) > 1 else []
            found.append((a, b, rest, not rest))
            run = [b]
        found += [(x, y, (), True) for x, y in packed_spans(run, size, overlap)] if len(run) > 1 else []
        todo += reversed(found)
    chunks = (re.sub(r"\n{2,}", "\n", text[a:b].strip()) for a, b in spans)
    return [c for c in chunks if c]


def split_recursive(text: str, size: int = 400, overlap: int = 50) -> list[str]:
    return split_by_rules(text, SECTION_SEPARATORS, size, overlap)


def split_characters(text: str, size: int = 400, overlap: int = 0) -> list[str]:
    return split_by_rules(text, tuple(re.escape(s) for s in CHARACTER_SEPARATORS), size, overlap)


def split_sections(text: str, size: int = 400, overlap: int = 50) -> list[str]:
    return split_by_rules(text, (SECTION_RULE,), size, overlap)


def split_sentences(text: str, **_) -> list[str]:
    """Sentences by the marks that end them; sizes do not matter."""
    return [x for x in re.split(sentence_pattern().replace(r"\z", r"\Z"), text) if x.strip()]


def merge_small(chunks: list[str], least: int = 80) -> list[str]:
    """In order: a chunk under `least` characters takes in the next ones until it has twice that; a last one still under it joins the one before."""
    out: list[str] = []
    growing = False
    for chunk in chunks:
        if growing and len(out[-1]) < 2 * least:
            out[-1] += "\n" + chunk
        else:
            out.append(chunk)
            growing = len(chunk) < least
    if len(out) > 1 and len(out[-1]) < least:
        last = out.pop()
        out[-1] += "\n" + last
    return out


#: Splitters by name; register more with `register_splitter`. An unknown name stands for the splitter into sentences.
SPLITTERS: dict[str, Callable[[str], list[str]]] = {"recursive": split_recursive, "characters": split_characters, "sections": split_sections, "sentences": split_sentences}


def register_splitter(name: str, split: Callable[[str], list[str]]) -> None:
    SPLITTERS[name] = split


def splitter(name: str) -> Callable[[str], list[str]]:
    return SPLITTERS.get(name, split_sentences)
