"""Secret scans: fixed patterns, and strings that a tokenizer cannot compress.

Kinds, in the order in which spans that start together are listed:

* assign: a name like password or token, a colon or equals sign, and a value of at least 6 characters;
* access: AKIA and capitals or digits, at least 20 characters in all;
* hex: at least 24 digits 0-9a-f in a row;
* random: a run of at least RUN letters, digits and `+/_-` with no more than RATIO characters per token of
  the given vocabulary. Words of any language are in a vocabulary by pieces of two to four letters, random
  strings only by one or two. It must mix letters and digits, or hold several letters of either case.
  Digests of usual length, UUIDs and identifiers (words and numbers joined by `+/_-`) are left out. Where spans of
  the fixed patterns cover parts of a run, each part beside them is judged as a run of its own.

Spans count code points, the end is exclusive. A pattern's matches are leftmost and do not overlap; one that
fails its length is dropped and still takes up its text. Null and empty texts have no spans. The functions
work on a column, so other columns, repeated rows and empty tables do not matter.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from larder.llm.vocabularies import path_of, tiktoken_encoding

KINDS = ("assign", "access", "hex", "random")
SPANS = "array<struct<kind:string,start:int,end:int>>"
RUN, RATIO, JOINTS = 20, 2.0, "+/_-="
DIGESTS = {32, 40, 48, 56, 64, 96, 128}

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(r"[0-9a-f]{24,}")
_RUN = re.compile(rf"[A-Za-z0-9+/_-]{{{RUN},}}={{0,2}}")
_DIGEST = re.compile(r"[0-9a-f]+|[0-9A-F]+")
_UUID = re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}")
_PART = re.compile(r"[A-Za-z]*|[0-9]+|[A-Za-z][a-z]*[0-9]{1,4}")


def known(run: str) -> bool:
    """A digest, a UUID or an identifier."""
    if len(run) in DIGESTS and _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    parts = re.split(r"[+/_=-]+", run)
    return len(parts) > 1 and all(_PART.fullmatch(p) for p in parts)


def mixed(run: str) -> bool:
    digits, upper = sum(c.isdigit() for c in run), sum(c.isupper() for c in run)
    letters = sum(c.isalpha() for c in run)
    return bool(digits and letters) or upper >= 3 and letters - upper >= 3 and not run[1:].islower()


def spans_of(text: str | None, path: str, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, place of the kind, end), sorted."""
    if not text:
        return []
    found = []
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    runs = [m.span() for m in _RUN.finditer(text)]
    if runs:  # whatever the next two find lies in such a run
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text)]
        found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
        found.sort()
        at, reach, added = 0, 0, []
        for start, end in runs:
            parts, free = [], max(start, reach)
            while at < len(found) and found[at][0] < end:
                parts.append((free, found[at][0]))
                reach, at = max(reach, found[at][2]), at + 1
                free = max(free, reach)
            for i, j in [*parts, (free, end)]:
                if (i, j) != (start, end):  # what stands beside a span loses the signs between them
                    i, j = i + len(text[i:j]) - len(text[i:j].lstrip(JOINTS)), j - len(text[i:j]) + len(text[i:j].rstrip(JOINTS))
                run = text[i:j]
                if len(run) >= RUN and mixed(run) and not known(run) and len(run) <= ratio * len(tiktoken_encoding(path).encode_ordinary(run)):
                    added.append((i, 3, j))
        found += added
    found.sort()
    return found


def _column(run, kind: str) -> Column:
    return F.arrow_udf(run, kind)


def find_secrets(text: Column, path: str | None = None, ratio: float = RATIO) -> Column:
    """Spans of a text column as an array of (kind, start, end); `path` names a tiktoken rank file."""
    path = path or path_of("byte_bpe_50k.tiktoken")
    spans_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def run(texts: pa.Array) -> pa.Array:
        rows = [[{"kind": KINDS[k], "start": s, "end": e} for s, k, e in spans_of(t.as_py(), path, ratio)] for t in texts]
        return pa.array(rows, spans_type)

    return _column(run, SPANS)(text)


def redact(text: Column, mark: str = "[SECRET]", path: str | None = None, ratio: float = RATIO) -> Column:
    """The text with every stretch that spans cover replaced by the mark; a null text stays null."""
    path = path or path_of("byte_bpe_50k.tiktoken")

    def run(texts: pa.Array) -> pa.Array:
        out = []
        for value in texts:
            whole = value.as_py()
            parts, done = [], 0
            for start, _, end in spans_of(whole, path, ratio):
                if start >= done:
                    parts += [whole[done:start], mark]
                done = max(done, end)
            out.append("".join([*parts, whole[done:]]) if parts else whole)
        return pa.array(out, pa.string())

    return _column(run, "string")(text)
