"""Secret scans with multipart credential linking.

Three base patterns report on their own. Weak candidates (user names and client ids, random-looking strings, endpoints)
report only when complementary parts co-occur: an interval join by distance inside a scope, a scope being a block of
text between blank lines. The join is a merge of sorted intervals in the row's own task, so nothing is shuffled, hot
sources do not matter and repeated rows are scanned alike.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Largest gap in code points between the parts of one credential.
LINK_DISTANCE = 300

KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
BASE_KINDS = KINDS[:3]

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}")  # whole runs only, as [0-9a-f]+ would give before the length test
KEYWORD = re.compile(r"(?ai:passw|secret|token|api_?key)")

IDENTIFIER = re.compile(r"""(?ai:access_?key_?id|client_?id|account_?id|user_?name|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@._-]{4,})""")
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{16,}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"""(?ai:https?|ftp|jdbc:[a-z]+|postgres|mysql|mongodb|redis|amqp)://[^\s"'<>]+""")
BLANK_LINE = re.compile(r"\n[\x20\t\r]*\n")

Span = tuple[int, int]


def base_spans(text: str) -> dict[str, list[Span]]:
    """Leftmost non-overlapping matches of each base kind, as code-point spans."""
    found: dict[str, list[Span]] = {"assign": [], "access": [], "hex": [m.span() for m in HEX.finditer(text)]}
    if KEYWORD.search(text):
        found["assign"] = [m.span() for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found["access"] = [m.span() for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    return found


def random_looking(token: str) -> bool:
    """Three character classes and many different characters, as generated keys have."""
    classes = sum(any(map(test, token)) for test in (str.islower, str.isupper, str.isdigit))
    return classes == 3 and len(set(token)) >= 10


class Intervals:
    """Sorted spans; near() finds whether one lies within a distance, in the same scope and not the span itself."""

    def __init__(self, spans: list[Span], breaks: list[int]):
        self.spans = sorted(set(spans))
        self.starts, self.breaks = [s for s, _ in self.spans], breaks
        self.reach, end = [], 0  # the furthest end so far, for spans that overlap
        for _, e in self.spans:
            end = max(end, e)
            self.reach.append(end)

    def near(self, span: Span) -> bool:
        start, end = span
        scope = bisect.bisect_right(self.breaks, start)
        low = max(start - LINK_DISTANCE, self.breaks[scope - 1] if scope else 0)
        high = min(end + LINK_DISTANCE, self.breaks[scope] if scope < len(self.breaks) else end + LINK_DISTANCE)
        i = bisect.bisect_left(self.starts, high) - 1
        while i >= 0 and self.reach[i] > low:
            s, e = self.spans[i]
            if e > low and s < high and not (s < end and start < e):
                return True
            i -= 1
        return False


def linked_spans(text: str, base: dict[str, list[Span]]) -> dict[str, list[Span]]:
    """Weak candidates whose complementary parts co-occur within a scope."""
    out: dict[str, list[Span]] = {"identifier": [], "secret": [], "endpoint": []}
    names = [m.span() for m in IDENTIFIER.finditer(text)]
    identifiers = base["access"] + names
    strong = base["assign"] + base["hex"]
    if not identifiers:
        return out  # without an identifier no group of parts is complete
    breaks = [m.start() for m in BLANK_LINE.finditer(text)]
    urls = [m.span() for m in ENDPOINT.finditer(text)]
    known = Intervals(strong + base["access"] + names + urls, [])
    weak = [m.span() for m in CANDIDATE.finditer(text) if random_looking(m[0])]
    weak = [w for w in weak if not overlaps(known, w)]
    by_identifier = Intervals(identifiers, breaks)
    out["secret"] = [w for w in weak if by_identifier.near(w)]
    by_secret, by_endpoint = Intervals(strong + out["secret"], breaks), Intervals(urls, breaks)
    out["identifier"] = [n for n in names if by_secret.near(n) and by_endpoint.near(n)]
    out["endpoint"] = [u for u in urls if by_identifier.near(u) and by_secret.near(u)]
    return out


def overlaps(known: Intervals, span: Span) -> bool:
    i = bisect.bisect_left(known.starts, span[1]) - 1
    return i >= 0 and known.reach[i] > span[0]


def joined(spans: dict[str, list[Span]]) -> str:
    rows = sorted((s, KINDS.index(kind), e) for kind, found in spans.items() for s, e in found)
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in rows)


def scan_text(text: str | None) -> dict:
    """All spans of one text; a null text counts as empty."""
    text = text or ""
    base = base_spans(text)
    added = linked_spans(text, base)
    return {
        "n_assign": len(base["assign"]),
        "n_access": len(base["access"]),
        "n_hex": len(base["hex"]),
        "n_linked": sum(map(len, added.values())),
        "base_spans": joined(base),
        "spans": joined(base | added),
    }


RESULT = pa.struct([(c, pa.int64()) for c in ("n_assign", "n_access", "n_hex", "n_linked")] + [("base_spans", pa.string()), ("spans", pa.string())])
RESULT_DDL = "struct<n_assign:bigint,n_access:bigint,n_hex:bigint,n_linked:bigint,base_spans:string,spans:string>"


def scan(text: Column) -> Column:
    """Struct column with the counts and spans of every whole text."""

    @F.arrow_udf(RESULT_DDL)
    def _scan(texts: pa.Array) -> pa.Array:
        return pa.array([scan_text(x) for x in texts.to_pylist()], RESULT)

    return _scan(text)


def redacted_text(text: str | None, mark: str) -> str | None:
    """A text with mark in place of each run of overlapping spans; null stays null."""
    if not text:
        return text
    base = base_spans(text)
    out, at = [], 0
    for start, end in sorted(s for found in (base | linked_spans(text, base)).values() for s in found):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, text: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every secret of the text column replaced by mark; other columns and rows stay as they are."""

    @F.arrow_udf("string")
    def _redact(texts: pa.Array) -> pa.Array:
        return pa.array([redacted_text(x, mark) for x in texts.to_pylist()], pa.string())

    return docs.withColumn(text, _redact(F.col(text)))


def scan_documents(docs: DataFrame, text: str = "text", result: str = "secrets") -> DataFrame:
    """docs with a struct column `result`; an input column of that name is replaced. Rows stay as they are, repeated
    rows and null ids included; null and empty texts have no spans; an empty table gives an empty table."""
    return docs.withColumn(result, scan(F.col(text)))
