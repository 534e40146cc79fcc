"""Secret scans: fixed patterns, and novelty measured with a dictionary-primed zstandard compressor.

Base spans are the leftmost non-overlapping matches of each pattern that pass its length. The method then looks at every
token of 16 or more of the characters A-Za-z0-9+/_.=- that has a sensitive word within AROUND characters before or after it,
on any line, and overlaps no base span. NAME=value is split at its signs and sensitive words; a value that a sensitive name is
given by : or = may be as short as 8. The body of a PEM private key is one token. It compresses the surrounding text with and without the token, with a dictionary of
identifiers and code; a token that adds at least NOVELTY bytes for each of its characters is reported as kind `novel`.

learned() extends the dictionary by the corpus: the WORDS commonest words and parts of identifiers (whole runs of 4 to 12
letters, in OFTEN documents at least) that stand around sensitive words. Parts of random tokens are hardly ever such runs.

Defined cases: null text counts as empty (no spans); equal rows give equal results; columns other than text are kept.
One pass, no shuffle (learning the dictionary is one more, which moves words and counts only); memory is a few times one
batch of texts.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._common import lean, sha

KINDS = ("assign", "access", "hex", "novel")
NOVELTY, CONTEXT, AROUND = 0.7, 40, 512
WORDS, OFTEN, LEVEL = 4096, 3, 9
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = (b"passw", b"secret", b"token", b"api")
#: Words that make their surroundings sensitive, beside those of the assign pattern.
SENSITIVE = ("password", "passwd", "passphrase", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "accesskey", "private_key", "privatekey", "credential", "bearer", "authorization", "auth_", "private key", "client_id", "session_id", "cookie", "signature")
_SENSITIVE = re.compile("|".join(SENSITIVE), re.IGNORECASE | re.ASCII)
_SENSITIVE_BYTES = tuple(w.encode() for w in SENSITIVE)
#: Least characters of a token, and of a value after a name and a sign.
LENGTH, SHORT = 16, 8
_RUN = re.compile(r"[A-Za-z0-9+/_.=-]{8,}")
#: A sign between a name and a value; signs at the end are padding.
_SIGN = re.compile(r"=+(?=[^=])")
#: A name before a sign is not a value if it is letters of one case.
_NAME = re.compile(r"(?:[A-Z_.-]+|[a-z_.-]+)[0-9]*=+")
#: A value that a sensitive name is given, perhaps on the next line.
_DIRECT = re.compile(rf"""(?:{"|".join(SENSITIVE)})[A-Za-z0-9_.-]{{0,{CONTEXT}}}["']?\s{{0,{CONTEXT}}}[:=]>?\s{{0,{CONTEXT}}}["']?([A-Za-z0-9+/_.-][A-Za-z0-9+/_.=-]{{{SHORT - 1},}})""", re.IGNORECASE | re.ASCII)
_PEM = re.compile(r"-----(?:(BEGIN) [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----|END )")
_KEY_LINES = re.compile(r"(?:\s{0,80}[A-Za-z0-9+/=]{16,})*")
#: What code and configuration around a secret is made of; the compressor knows it before it sees a text.
DICTIONARY = """
import os sys json config settings environment def class return function const public private static void string int self
password passwd passphrase username user_name secret client_secret token access_token refresh_token api_key apikey x-api-key
private_key public_key ssh-rsa BEGIN RSA PRIVATE KEY END CERTIFICATE credential credentials authorization Bearer Basic session
session_id cookie signature access_key_id secret_access_key region us-east-1 database connection_string host localhost port
http:// https:// www .com .org .net .json .yaml .xml .html /usr/local/bin /home/ /var/log example placeholder changeme
true false null none undefined default value name type key id url path file data content-type application/json utf-8
getElementById addEventListener toString valueOf hasOwnProperty setAttribute prototype constructor request response headers
the of and to in is that for with from this which have not are was were been their there would could should about other
abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 00000000000000000000 ----------------------------------
================================ ................................ ________________________________ -_.=+/
"""


#: Words, and parts of identifiers between other signs.
_PART = re.compile(r"(?<![A-Za-z0-9])[A-Za-z]{4,12}(?![A-Za-z0-9])")


def learned(docs: DataFrame, dictionary: str = DICTIONARY) -> str:
    """dictionary, and before it the words that are common around sensitive words in docs, the commonest last."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter[str] = Counter()
        names = ["word", "n"]
        for b in batches:
            for text in b.column(0).to_pylist():
                low = (text or "").encode().lower()
                if any(w in low for w in _SENSITIVE_BYTES):
                    found.update({w for a, z in _regions(text) for w in _PART.findall(text, max(0, a), max(0, z))})
            if len(found) > 200_000:
                yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names)
                found.clear()
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], names)

    counts = docs.select("text").mapInArrow(lean(run), "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= OFTEN)
    common = [r["word"] for r in counts.orderBy(F.desc("n"), "word").limit(WORDS).collect()]
    return "\n".join([*reversed(common), dictionary])


def _regions(text: str) -> list[tuple[int, int]]:
    """Where a token has a sensitive word among the AROUND characters before or after it, ascending; may begin before 0."""
    out: list[tuple[int, int]] = []
    for m in _SENSITIVE.finditer(text):
        if out and m.end() - AROUND <= out[-1][1]:
            out[-1] = (out[-1][0], m.start() + AROUND)
        else:
            out.append((m.end() - AROUND, m.start() + AROUND))
    return out


def _compressor(dictionary: str) -> zstandard.ZstdCompressor:
    primed = zstandard.ZstdCompressionDict(dictionary.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    primed.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=primed, write_checksum=False, write_content_size=False, write_dict_id=False)


def base_spans(text: str, raw: bytes | None = None) -> list[tuple[int, int, int]]:
    """(start, kind's place in KINDS, end) in code points, ascending."""
    raw = text.encode() if raw is None else raw
    low, found = raw.lower(), []
    if any(w in low for w in _WORDS) and (b"=" in raw or b":" in raw):
        found += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 8]
    if b"AKIA" in raw:
        found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _key_blocks(text: str) -> list[tuple[int, int]]:
    """The bodies of PEM private keys: up to the next header or footer, or the lines of a key's characters if no footer follows."""
    marks = list(_PEM.finditer(text)) if "PRIVATE KEY" in text else []
    out = []
    for m, after in zip(marks, [*marks[1:], None], strict=False):
        if m[1]:
            closed = after is not None and not after[1]
            body = text[m.end() : after.start()] if closed else _KEY_LINES.match(text, m.end())[0]
            left = len(body) - len(body.lstrip())
            out.append((m.end() + left, m.end() + len(body.rstrip()) if body.strip() else m.end() + left))
    return out


def novel_spans(text: str, low: bytes, base: list[tuple[int, int, int]], compressor: zstandard.ZstdCompressor, novelty: float = NOVELTY) -> list[tuple[int, int, int]]:
    if not any(w in low for w in _SENSITIVE_BYTES):
        return []
    regions = _regions(text)
    out, begins, ends = [], [], []  # begins, ends: what is taken by base spans and key blocks, ascending
    for s, _, e in base:
        if ends and s <= ends[-1]:
            ends[-1] = max(ends[-1], e)
        else:
            begins.append(s)
            ends.append(e)

    def test(start: int, end: int) -> bool:
        """Whether text[start:end] is novel; if so, it is reported."""
        i = bisect.bisect_right(ends, start)
        if i < len(ends) and begins[i] < end:
            return False
        before = text[max(0, start - AROUND) : start].encode()
        after = text[end : end + AROUND].encode()
        token = text[start:end].encode()
        added = len(compressor.compress(before + after + token)) - len(compressor.compress(before + after))
        if added < novelty * len(token):
            return False
        out.append((start, 3, end))
        return True

    for start, end in _key_blocks(text):
        if end - start >= LENGTH and test(start, end):
            i = bisect.bisect_right(ends, start)
            begins.insert(i, start)
            ends.insert(i, end)
    direct = {m.start(1) for m in _DIRECT.finditer(text)}
    r = 0
    for m in _RUN.finditer(text):
        while r < len(regions) and regions[r][1] < m.start():
            r += 1
        if r == len(regions):
            break
        if m.end() < regions[r][0]:
            continue
        # NAME=value: the value; if it is not novel as a whole, what stands between its own signs and sensitive words
        signs = [m.start() + c.end() for c in _SIGN.finditer(m[0])]
        least = SHORT if signs and signs[0] in direct else LENGTH
        last = m.end()
        if len(signs) > 1 and last - signs[0] >= least and test(signs[0], last):
            last, signs = signs[0], []
        words = [x for w in _SENSITIVE.finditer(m[0]) for x in (m.start() + w.start(), m.start() + w.end()) if x < last]
        cuts = sorted({m.start(), *signs, *words, last})
        for a, z in zip(cuts, cuts[1:], strict=False):
            if z - a >= (SHORT if a in direct else LENGTH) and not (z in signs and _NAME.fullmatch(text, a, z)):
                test(a, z)
    return out


def joined(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def scan(docs: DataFrame, keep: list[str] | None = None, dictionary: str = DICTIONARY, novelty: float = NOVELTY) -> DataFrame:
    """The kept columns of docs (all but text, if not said) and n_assign, n_access, n_hex, base_sha256, spans, n_novel, redacted.

    redacted is the text with every span replaced by <SECRET>; overlapping spans are replaced as one. Columns of docs that
    have one of these names are replaced.
    """
    new = ["n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel", "redacted"]
    keep = [c for c in (docs.columns if keep is None else keep) if c != "text" and c not in new]
    source = docs.select("text", *keep)
    schema = docs.select(*keep).schema
    for c in new:
        schema = schema.add(c, "long" if c[:2] == "n_" else "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compressor = _compressor(dictionary)
        for b in batches:
            rows: list[list] = [[] for _ in new]
            for text in b.column(0).to_pylist():
                text = text or ""
                raw = text.encode()
                base = base_spans(text, raw)
                every = sorted(base + novel_spans(text, raw.lower(), base, compressor, novelty))
                clean, at = [], 0
                for s, _, e in every:
                    if s >= at:
                        clean += [text[at:s], "<SECRET>"]
                    at = max(at, e)
                counts = [sum(k == i for _, k, _ in every) for i in range(4)]
                for col, v in zip(rows, [*counts[:3], sha(joined(base).encode()), joined(every), counts[3], "".join([*clean, text[at:]])], strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(c, pa.int64() if n[:2] == "n_" else pa.string()) for n, c in zip(new, rows, strict=True))], [*keep, *new])

    return source.mapInArrow(lean(run), schema)
