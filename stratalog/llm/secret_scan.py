"""Secret scans by dictionary-primed zstandard novelty.

Three fixed patterns give the base spans. Beyond them, every run of key-like characters
with a sensitive word in the text around it is measured: how many bytes does it add to a
compressor primed with common identifiers and with that text? Names and repeated code are
cheap after that priming; a random key costs as much as its characters in any order, and
is reported as a span of kind novel. So is a long word that the text has only once.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import batches, lean, text_rows

# The base patterns and the least lengths that count.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
ASSIGN_LEAST, ACCESS_LEAST = 6, 20
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = ("password", "passwd", "secret", "token", "api_key", "apikey", "credential", "bearer", "private_key")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_KEYLIKE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: How much text on either side may hold the sensitive word and primes the compressor, the
#: least share of the bytes of the same characters in random order, and the least bytes.
AROUND, NOVEL_SHARE, NOVEL_BYTES = 512, 0.7, 10
IDENTIFIERS = (
    " access_token refresh_token client_secret client_id api_key private_key public_key authorization Bearer Basic password passwd username"
    " credentials config settings environment getenv os.environ process.env localhost example default undefined placeholder changeme"
    " function return import export const static public private string boolean integer request response headers content application/json"
    " https://www. http:// .example.com /usr/local/bin /etc/ 0123456789 abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ xxxxxxxxxxxxxxxx ****************"
).encode()


def novelty(candidate: str, around: str) -> float:
    """Bytes that the candidate adds to a primed frame, per byte of its own."""
    own = candidate.encode("utf-8", "surrogatepass")
    primed = zstandard.ZstdCompressionDict(IDENTIFIERS + around.encode("utf-8", "surrogatepass"), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    zip_ = zstandard.ZstdCompressor(level=9, dict_data=primed, write_content_size=False, write_checksum=False, write_dict_id=False)
    return (len(zip_.compress(own)) - len(zip_.compress(b""))) / max(1, len(own))


def is_novel(candidate: str, around: str) -> bool:
    """Whether the new bytes come near those of the candidate's own characters in random order."""
    own = novelty(candidate, around)
    if len(set(candidate)) == 1 or own * len(candidate) < NOVEL_BYTES:
        return False
    mixed = "".join(random.Random(0).sample(candidate, len(candidate)))
    return own >= NOVEL_SHARE * novelty(mixed, around)


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) in code points, by start, then kind as listed."""
    low, found = text.lower(), []
    if any(w in low for w in ("password", "passwd", "secret", "token", "api_key", "apikey")):
        found += [(*m.span(), "assign") for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        found += [(*m.span(), "access") for m in ACCESS.finditer(text) if len(m[0]) >= ACCESS_LEAST]
    found += [(*m.span(), "hex") for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def novel_spans(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int, str]]:
    """Candidates with a sensitive word near on either side that touch no base span and are
    new against their surroundings. A run that holds such words is measured between them
    or, where no part is long enough, as a whole."""
    low, found = text.lower(), []
    if not any(w in low for w in SENSITIVE):
        return []
    words = [m.span() for m in _SENSITIVE.finditer(text)]
    ends, taken = [e for _, e in words], [e for _, e, _ in sorted(base)]
    base = sorted(base)
    for run in _KEYLIKE.finditer(text):
        first = bisect_left(ends, run.start() - AROUND)
        if first == len(words) or words[first][0] > run.end() + AROUND:
            continue
        cuts, at = [run.start()], bisect_left(ends, run.start() + 1)
        while at < len(words) and words[at][0] < run.end():
            cuts += words[at]
            at += 1
        cuts.append(run.end())
        parts = [m.span() for a, b in zip(cuts[::2], cuts[1::2], strict=True) if a < b for m in _KEYLIKE.finditer(text, a, b)]
        for start, end in parts or [run.span()]:
            i = bisect_left(taken, start + 1)
            if i < len(base) and base[i][0] < end:
                continue
            around = text[max(0, start - AROUND) : start] + " " + text[end : end + AROUND]
            if is_novel(text[start:end], around):
                found.append((start, end, "novel"))
    return found


def render(spans: list[tuple[int, int, str]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for s, e, k in spans)


def scan(text: str) -> dict:
    base = base_spans(text)
    novel = novel_spans(text, base)
    every = sorted(base + novel, key=lambda s: (s[0], KINDS.index(s[2])))
    counts = {f"n_{k}": sum(s[2] == k for s in every) for k in KINDS}
    return counts | {"base_sha256": hashlib.sha256(render(base).encode()).hexdigest(), "spans": render(every)}


@lean
def _scan_rows(rows: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in rows:
        found = [scan(t) for t in b.column(1).to_pylist()]
        kinds = {f"n_{k}": ([f[f"n_{k}"] for f in found], pa.int64()) for k in KINDS}
        yield batches({"doc_id": (b.column(0), pa.int64())} | kinds | {c: ([f[c] for f in found], pa.string()) for c in ("base_sha256", "spans")})


def secret_scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_novel, base_sha256, spans), one row per row.

    A null text counts as empty: no spans, and base_sha256 of the empty string. Whole
    texts are read however long; a null doc_id is passed on; repeated rows give equal
    results; an empty table gives none; other columns are not read.
    """
    return text_rows(docs).mapInArrow(_scan_rows, "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")
