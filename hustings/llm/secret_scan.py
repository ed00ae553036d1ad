"""Secret scan: three fixed kinds, and zstandard novelty primed with a dictionary.

A candidate is a run of 16 or more characters of an opaque alphabet near a word that names a
credential. Its novelty is the number of bytes that zstandard needs for it beyond the fixed cost
of a frame, when the compressor is primed with the code around the candidate and a dictionary of
ordinary identifiers: words and names seen there cost next to nothing, random strings cost close
to their entropy. Candidates that stay incompressible are reported as kind `novel` if no other
span covers them.

Defined cases: a null text is empty and holds nothing; equal rows give equal results, and rows that repeat are each
reported; offsets are code points, ends exclusive; of overlapping candidates the one that is met first stands, and
none that overlaps a fixed kind; texts of any length are scanned whole, in time in proportion to them, however many
secrets they hold; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hustings.llm.common import prepare, steps, texts, utf8

ASSIGN = re.compile(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
KINDS = ("assign", "access", "hex", "novel")
#: Words that make a context sensitive, in any case, and what each assignment needs one of.
CONTEXT_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key", "api-key", "credential", "private", "bearer", "authorization", "access_key", "client_key", "auth")
ASSIGN_WORDS = (b"password", b"passwd", b"secret", b"token", b"api_key", b"apikey")
CONTEXT = re.compile("|".join(map(re.escape, CONTEXT_WORDS)), re.IGNORECASE | re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What may part the lines of one secret, what joins the parts of one token, and the rest of one that ends in padding.
GAP = re.compile(r"""(?:\s|\\[nr]|["'+\\])+""")
JOINT = re.compile(r"[.:~](?=[A-Za-z0-9+/_=-]{16})")
LAST = re.compile(r"[A-Za-z0-9+/_-]{1,15}={1,2}(?![A-Za-z0-9+/_=-])")
PRIVATE_KEY = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)(?:-----END|\Z)", re.DOTALL)
TAIL = re.compile(r"""([A-Za-z0-9+/=]{1,15})(?:\s|\\[nr]|["'+\\])*\Z""")
#: Characters on either side in which a context word must stand, and around a candidate that prime the compressor.
NEAR, AROUND = 48, 400
#: Bytes beyond the frame, for each character, from which a candidate counts as incompressible.
NOVELTY = 0.8
#: From this length zstandard codes literals by their alphabet, so a candidate is measured against this share of what a random string of its alphabet costs.
LONG, NEARLY = 48, 0.99
ALPHABETS = [(n, re.compile(f"[{c}]+=*")) for n, c in ((16, "0-9A-F"), (16, "0-9a-f"), (32, "A-Z2-7"), (36, "0-9a-z"), (36, "0-9A-Z"), (62, "0-9A-Za-z"))]
#: Ordinary identifiers of code, as a priming dictionary.
IDENTIFIERS = (
    b"public static final class function return import from export default const let var def self this None null true false "
    b"string integer boolean number object array list map dict value key name type data file path index length size count "
    b"user_name username user_id session_id request response client server config settings options parameters arguments "
    b"password secret token api_key access_key private_key public_key authorization authentication credential bearer "
    b"get_value set_value get_token refresh_token access_token client_secret client_id SECRET_KEY API_KEY ACCESS_KEY_ID "
    b"getElementById createElement addEventListener toString valueOf prototype constructor undefined exception error "
    b"http https www example com org net localhost index.html application/json content-type text/plain charset utf-8 "
    b"0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ "
)
_HEX = np.zeros(256, bool)
_HEX[[*range(0x30, 0x3A), *range(0x61, 0x67)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 0x20


@lru_cache(maxsize=1)
def _frame_cost() -> int:
    return len(_compressor(b"").compress(b""))


def _compressor(around: bytes) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False)


def novelty(candidate: str, around: str) -> float:
    """Marginal compressed bytes of the candidate for each of its characters."""
    raw = candidate.encode()
    return max(0, len(_compressor(around.encode()).compress(raw)) - _frame_cost() - 3) / max(1, len(raw))


def alphabet(candidate: str) -> int:
    """The number of characters of the smallest usual alphabet that holds the candidate."""
    for size, pattern in ALPHABETS:
        if pattern.fullmatch(candidate):
            return size
    return 64


def incompressible(candidate: str, around: str) -> bool:
    least = NOVELTY if len(candidate) < LONG else min(NOVELTY, NEARLY * math.log2(alphabet(candidate)) / 8)
    return novelty(candidate, around) >= least


def base_spans(text: str) -> list[tuple[int, int, str]]:
    out = [(m.start(), m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    out += [(m.start(), m.end(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [(m.start(), m.end(), "hex") for m in re.finditer(r"[0-9a-f]{24,}", text)]
    return out


def _covered(spans: list[tuple[int, int, str]]) -> tuple[list[int], list[int]]:
    """Starts and ends of the disjoint stretches that the spans cover, in order."""
    starts: list[int] = []
    ends: list[int] = []
    for a, b, _ in sorted(spans):
        if ends and a < ends[-1]:
            ends[-1] = max(ends[-1], b)
        else:
            starts.append(a)
            ends.append(b)
    return starts, ends


def novel_spans(text: str, known: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Incompressible candidates in sensitive contexts that no known span overlaps.

    A context reaches over NEAR characters to the right and to the left of its word, and from any
    secret to the next candidate that only white space, line ends or quotes part from it; what a dot, colon or
    tilde joins to a secret is a part of the same token. A block of a private key is taken to its end as soon as one of its candidates is incompressible.
    """
    starts, ends = _covered(known)  # of disjoint stretches, in order; found spans join them
    out: list[tuple[int, int]] = []
    judged: dict[tuple[int, int], bool] = {}
    walked: set[int] = set()

    def judge(a: int, b: int, sure: bool = False) -> bool:
        """Whether the candidate is or touches a secret; a new one is added."""
        if sure or (a, b) not in judged:
            judged[a, b] = True
            k = bisect_left(starts, b)
            if k == 0 or ends[k - 1] <= a:
                found = text[a:b]
                mixed = any(c.isdigit() for c in found) and any(c.isalpha() for c in found)  # words and numbers alone are ordinary
                judged[a, b] = sure or mixed and incompressible(found, text[max(0, a - AROUND) : a] + text[b : b + AROUND])
                if judged[a, b]:
                    out.append((a, b))
                    starts.insert(k, a)
                    ends.insert(k, b)
        return judged[a, b]

    def onward(end: int) -> None:
        """From the end of a secret to what belongs to it or follows it; every end is walked from once."""
        while end not in walked:
            walked.add(end)
            if joint := JOINT.match(text, end):
                m = CANDIDATE.match(text, joint.end())
                judge(*m.span(), sure=True)
                end = m.end()
            elif (gap := GAP.match(text, end)) and (m := CANDIDATE.match(text, gap.end())) and judge(*m.span()):
                end = m.end()
            elif gap and (m := LAST.match(text, gap.end())):  # what is left of a padded key
                judge(*m.span(), sure=True)

    runs = [m.span() for m in CANDIDATE.finditer(text)]
    stops = [b for _, b in runs]
    reached = 0
    for word in CONTEXT.finditer(text):
        for a, b in runs[bisect_left(stops, word.start() - NEAR) : bisect_right(stops, word.start())]:
            if judge(a, b):
                onward(b)
        at = max(word.end(), reached)
        k = bisect_left(stops, at + 16)  # a run may begin before the word ends
        while k < len(runs) and (a := max(runs[k][0], at)) <= word.end() + NEAR:
            reached = at = stops[k]
            if judge(a, at):
                onward(at)
            k += 1
    for block in PRIVATE_KEY.finditer(text):
        inside = [m.span() for m in CANDIDATE.finditer(text, *block.span(1))]
        if any([judge(a, b) for a, b in inside]):
            tail = TAIL.search(text, *block.span(1))
            for a, b in inside + ([tail.span(1)] if tail else []):
                judge(a, b, sure=True)
    return [(a, b, "novel") for a, b in sorted(out)]


def joined(spans: list[tuple[int, int, str]]) -> str:
    order = sorted(spans, key=lambda s: (s[0], KINDS.index(s[2]), s[1]))
    return ",".join(f"{k}:{a}:{b}" for a, b, k in order)


def suspects(column: pa.Array) -> np.ndarray:
    """Texts that may hold any span: a cheap look at the bytes that drops none with one."""
    data, offsets = utf8(column)
    hot = np.zeros(len(column), bool)
    if not len(data):
        return hot
    # a run of 24 hexadecimal digits
    run = np.flatnonzero(~_HEX[data])
    edges = np.concatenate([[-1], run, [len(data)]])
    for i in np.flatnonzero(np.diff(edges) > 24).tolist():
        a, b = int(edges[i]) + 1, int(edges[i + 1])
        d, e = np.searchsorted(offsets, [a, b - 1], "right") - 1
        hot[d : e + 1] = True
    # a word of any list, wherever it stands
    lower = _LOWER[data].tobytes()
    for word in {*ASSIGN_WORDS, b"akia", *(w.encode() for w in CONTEXT_WORDS)}:
        at = lower.find(word)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            hot[d] = True
            at = lower.find(word, int(offsets[d + 1]))
    return hot


def scan_text(text: str) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    known = base_spans(text)
    return known, novel_spans(text, known)


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256 and spans (kind:start:end, comma-joined), n_novel."""
    prepare(docs.sparkSession)
    names = ["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"]
    nothing = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                n = part.num_rows
                counts = {k: np.zeros(n, np.int64) for k in KINDS}
                sha, spans = [nothing] * n, [""] * n
                column = texts(part.column("text"))
                for i in np.flatnonzero(suspects(column)).tolist():
                    base, novel = scan_text(column[i].as_py())
                    for _, _, kind in base + novel:
                        counts[kind][i] += 1
                    sha[i], spans[i] = hashlib.sha256(joined(base).encode()).hexdigest(), joined(base + novel)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *(pa.array(counts[k]) for k in KINDS[:3]), pa.array(sha, pa.string()), pa.array(spans, pa.string()), pa.array(counts["novel"])], names)

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return rows.mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long")


def masked(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span, or overlapping spans together, replaced by [SECRET]."""
    out, at = [], 0
    for a, b, _ in sorted(spans):
        if a >= at:
            out += [text[at:a], "[SECRET]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def mask(docs: DataFrame) -> DataFrame:
    """All documents and columns, with every secret in text replaced by [SECRET]; n_chars, if there, follows."""
    prepare(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in steps(batch, "text"):
                hot = np.flatnonzero(suspects(texts(part.column("text")))).tolist()
                if not hot:
                    yield part
                    continue
                values = part.column("text").to_pylist()
                for i in hot:
                    base, novel = scan_text(values[i])
                    values[i] = masked(values[i], base + novel)
                yield part.set_column(part.schema.get_field_index("text"), part.schema.field("text"), pa.array(values, part.schema.field("text").type))

    out = docs.mapInArrow(run, docs.schema)
    return out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out
