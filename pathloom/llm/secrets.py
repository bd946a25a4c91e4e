"""Secret scans: fixed patterns, and strings in sensitive places that nothing around them helps to compress.

The method: a candidate is a long unbroken string shortly after a word such as "password" or "authorization". Its
marginal compressed size is measured with zstandard primed by a dictionary, which holds the text around the candidate
and common identifiers of source code. Names, paths and repeated values come out short, random strings do not.
"""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pathloom.llm.store import map_columns, per_batch, read_table, slices

#: Fixed patterns of the base kinds.
ASSIGN = re.compile(r"(?ai:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
#: The runs of [0-9a-f]+ that have 24 characters or more; leftmost matches begin where a run does.
LONG_HEX = re.compile(r"[0-9a-f]{24,}")
#: Parts of lower-case text without which ASSIGN, or SENSITIVE, can't match: looked for first, as that is much faster.
ASSIGN_PARTS = ("passw", "secret", "token", "api")
SENSITIVE_PARTS = ("pass", "pwd", "secret", "token", "key", "credential", "auth", "bearer", "signature", "session", "cookie", "connection")
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(
    r"(?ai:pass(?:word|wd|phrase)|pwd|secret|token|api[_-]?key|access[_-]?key|private[_-]?key|client[_-]?key|credential|authorization|bearer|signature|auth|session[_-]?id|cookie|license[_-]?key|connection[_-]?string|BEGIN [A-Z ]*PRIVATE KEY)"
)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_.=~!@%^*-]{16,}")
#: What a candidate without a digit must have: letters that no separator parts.
LETTERS = re.compile(r"[A-Za-z+]{16,}")
#: Where a name in camel case goes on with its next word.
HUMP = re.compile(r"(?<=[a-z])(?=[A-Z])")
#: Key material behind a BEGIN line: lines of base64, the last of which may be short.
KEY_BEGIN = re.compile(r"(?a)BEGIN [A-Z ]*PRIVATE KEY-*[ \t]*\r?\n")
KEY_BODY = re.compile(r"(?:[ \t]*[A-Za-z0-9+/=]{16,}[ \t]*\r?\n)*[ \t]*[A-Za-z0-9+/=]+")
#: Common identifiers of source code, settings files and prose about them.
IDENTIFIERS = (
    "password passwd passphrase username user_name user_id userid client_id client_secret access_token refresh_token api_key apikey secret_key private_key public_key "
    "authorization authentication authenticate bearer basic session_id cookie credential credentials signature certificate encryption decrypt encrypt hash sha256 md5 base64 "
    "application configuration environment development production staging localhost example.com http:// https:// www. .com .org .net /usr/local/bin /home/user /etc/ /var/log/ /tmp/ "
    "function return class import from public static void string integer boolean null undefined true false self this const let var def lambda async await yield "
    "getElementById addEventListener getAttribute setAttribute createElement querySelector innerHTML toString valueOf constructor prototype hasOwnProperty "
    "database connection_string jdbc:mysql:// postgres:// redis:// mongodb:// host= port= database= table column select insert update delete where order_by group_by "
    "request response header content-type application/json charset=utf-8 timeout retry status_code error_message exception traceback warning information debug "
    "placeholder changeme change_me your_password_here your-api-key-here insert_token_here xxxxxxxxxxxxxxxx **************** 0000000000000000 1234567890 abcdefghijklmnopqrstuvwxyz "
    "ABCDEFGHIJKLMNOPQRSTUVWXYZ the and with that this from have which their there about would these other into could than first been after where most through should because under "
    "process.env os.environ getenv config.get settings.py .env yaml json xml properties docker kubernetes terraform ansible github gitlab jenkins release version number identifier parameter argument"
).encode()


#: Ordinary text that stands ahead of what is measured, so that zstandard codes letters by their frequency from the first on.
CARRIER = b"The meadow lies quiet under pale evening clouds while farmers walk homeward along winding lanes, talking softly about rain, barley, oxen and a jumbled fiddle tune played yesterday"


@lru_cache(1)
def identifier_dictionary(size: int = 8192, samples: int = 3000) -> bytes:
    """A zstandard dictionary, code tables included, trained on names made of the common identifiers. One for each worker."""
    pick, parts = random.Random(7), IDENTIFIERS.decode().split()
    names = []
    for i in range(samples):
        some = [pick.choice(parts) for _ in range(pick.randint(2, 6))]
        names.append(("".join(map(str.capitalize, some)) if i % 4 == 3 else "_.-"[i % 4].join(some)).encode())
    return zstandard.train_dictionary(size, names, level=3).as_bytes()


def base_spans(text: str, lower: str) -> list[tuple[int, int, str, int, int]]:
    """(start, end, kind, value start, value end) of the fixed patterns, leftmost and non-overlapping within each kind."""
    found = []
    if any(part in lower for part in ASSIGN_PARTS):
        found += [(*m.span(), "assign", *m.span(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [(*m.span(), "access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(*m.span(), "hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return found


class Novelty:
    """Marginal compressed bytes of a string, primed by its surroundings and the identifier dictionary."""

    def __init__(self, around: int = 512, level: int = 3, piece: int = 48):
        self.around, self.level, self.piece = around, level, piece

    def ratio(self, text: str, start: int, end: int) -> float:
        """What text[start:end] adds in compressed bytes to what stands around it, over its own bytes.

        It is measured in pieces of `piece` characters at most, each behind those before it: a longer piece would be
        coded by the letters' frequencies, and random letters of a small alphabet be taken for something known.
        """
        pieces = -(-(end - start) // self.piece)
        edges = [start + (end - start) * i // pieces for i in range(pieces + 1)]
        added = sum(
            self.size(text[max(0, a - self.around) : a].encode(), text[a:b].encode(), text[end : end + self.around].encode()) for a, b in zip(edges, edges[1:], strict=False)
        )
        return added / len(text[start:end].encode())

    def folded_ratio(self, text: str, start: int, end: int) -> float:
        """ratio() of the candidate in small letters and with its humps parted, over its own bytes.

        Names in camel case or capitals become the words they are made of, which are known; in random letters each
        change of case adds something that is not.
        """
        before, own = text[max(0, start - self.around) : start], folded(text[start:end])
        ratio = self.ratio(before + own + text[end : end + self.around], len(before), len(before) + len(own))
        return ratio * len(own) / (end - start)

    def size(self, before: bytes, candidate: bytes, after: bytes) -> int:
        """What the candidate adds in compressed bytes to ordinary text behind what stands around it."""
        primer = zstandard.ZstdCompressionDict(identifier_dictionary() + after + before, dict_type=zstandard.DICT_TYPE_FULLDICT)
        compress = zstandard.ZstdCompressor(level=self.level, dict_data=primer, write_content_size=False, write_checksum=False, write_dict_id=False).compress
        return len(compress(CARRIER + candidate)) - len(compress(CARRIER))


def shapes(value: str) -> int:
    """How many of lower case, upper case and digits a string has."""
    return any("a" <= c <= "z" for c in value) + any("A" <= c <= "Z" for c in value) + any("0" <= c <= "9" for c in value)


def folded(value: str) -> str:
    return (HUMP.sub("_", value) if value != value.upper() else value).lower()


def novel_spans(
    text: str, taken: list[tuple[int, int]], reach: int = 48, least_ratio: float = 0.81, least_ratio_lower: float = 0.76, least_folded: float = 0.75, least_folded_one_case: float = 0.66
) -> Iterator[tuple[int, int]]:
    """(start, end) of candidates no further than `reach` characters behind a sensitive word, free of taken spans, whose
    marginal compressed bytes reach a share of their own. With a digit and another kind of character: least_ratio, or
    least_ratio_lower without upper case, as fewer letters need fewer bits. Without a digit, where 16 letters stand
    unparted: the folded form's, least_folded, or least_folded_one_case where all letters are of one case. Behind the
    BEGIN line of a private key the candidate is its whole body, over all lines."""
    measure, done, covered = Novelty(), 0, sorted(taken)
    starts = [a for a, _ in covered]

    def novel(value: str, start: int, end: int) -> bool:
        if any(c.isdigit() for c in value):
            return shapes(value) > 1 and measure.ratio(text, start, end) >= (least_ratio_lower if value == value.lower() else least_ratio)
        least = least_folded if shapes(value) > 1 else least_folded_one_case
        return LETTERS.search(value) is not None and measure.folded_ratio(text, start, end) >= least

    def free(start: int, end: int) -> bool:
        near = covered[max(0, bisect_left(starts, start) - len(KINDS)) : bisect_left(starts, end)]
        return not any(a < end and start < b for a, b in near)

    for word in SENSITIVE.finditer(text):
        if word.end() >= done and (begin := KEY_BEGIN.match(text, word.start())) and (body := KEY_BODY.match(text, begin.end())):
            start, end = body.start() + len(body.group()) - len(body.group().lstrip()), body.end()
            if free(start, end) and shapes(text[start:end]) > 1 and measure.ratio(text, start, end) >= least_ratio:
                done = end
                yield start, end
                continue
        limit = word.end() + reach
        at = max(word.end(), done)
        # a candidate that starts in reach has its first 16 characters before limit + 16: no search goes further
        while at <= limit and (begin := CANDIDATE.search(text, at, limit + 16)):
            start, at = CANDIDATE.match(text, begin.start()).span()
            done = at
            value = text[start:at].rstrip(".=!")
            end = start + len(value)
            if len(value) >= 16 and free(start, end) and novel(value, start, end):
                yield start, end


def find_secrets(text: str | None) -> list[tuple[int, int, str, int, int]]:
    """All spans by start and kind: (start, end, kind, value start, value end) in code points; none for null and empty texts."""
    if not text:
        return []
    lower = text.lower()
    found = base_spans(text, lower)
    if any(part in lower for part in SENSITIVE_PARTS):
        taken = [x[:2] for x in found]
        found += [(a, b, "novel", a, b) for a, b in novel_spans(text, taken)]
    return sorted(found, key=lambda x: (x[0], KINDS.index(x[2])))


def redact(text: str | None, marker: str = "[SECRET]") -> str | None:
    """The text with each secret value replaced by the marker; overlapping values make one marker."""
    found = find_secrets(text)
    if not found:
        return text
    out, at = [], 0
    for start, end in sorted(x[3:] for x in found):
        if start >= at:
            out += [text[at:start], marker]
        at = max(at, end)
    return "".join(out) + text[at:]


SPAN = "array<struct<kind: string, start: long, end: long, value_start: long, value_end: long>>"


def scan_documents(docs: DataFrame) -> DataFrame:
    """doc_id and secrets (array of kind, start, end, value_start, value_end) for every row of docs, from whole texts.

    Null and empty texts have an empty array. Repeated rows are scanned one by one. No shuffle. Other columns of docs
    are ignored.
    """

    def run(batch: pa.RecordBatch):
        for part in slices(batch, 1):
            rows = [[{"kind": k, "start": a, "end": b, "value_start": c, "value_end": d} for a, b, k, c, d in find_secrets(t)] for t in part.column(1).to_pylist()]
            kind = pa.list_(pa.struct([("kind", pa.string()), *((n, pa.int64()) for n in ("start", "end", "value_start", "value_end"))]))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(rows, kind)], ["doc_id", "secrets"])

    return per_batch(docs.select(F.col("doc_id").cast("long"), "text"), run, f"doc_id long, secrets {SPAN}")


def redact_documents(docs: DataFrame) -> DataFrame:
    """docs with the secret values in text replaced, and n_chars (if there) counted anew for changed texts.

    Null and empty texts stay as they are; rows without doc_id and repeated rows are each redacted; an empty table gives
    an empty one. Other columns stay.
    """
    at = docs.columns.index("text")
    length_at = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, at):
                old = part.column(at).to_pylist()
                new = [redact(t) for t in old]
                columns = list(part.columns)
                columns[at] = pa.array(new, part.column(at).type)
                if length_at is not None:
                    was = part.column(length_at).to_pylist()
                    columns[length_at] = pa.array([len(b) if a != b else n for a, b, n in zip(old, new, was, strict=True)], part.column(length_at).type)
                yield pa.RecordBatch.from_arrays(columns, schema=part.schema)

    return map_columns(docs, run)


def span_list(spans):
    """kind:start:end, comma-joined, of a column of spans in their order."""
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans over the whole of documents."""
    found = scan_documents(read_table(spark, sf_dir, "documents"))
    count = lambda kind: F.size(F.filter("secrets", lambda x: x["kind"] == kind)).cast("long")
    base = span_list(F.filter("secrets", lambda x: x["kind"] != "novel"))
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in ("assign", "access", "hex")), F.sha2(base.cast("binary"), 256).alias("base_sha256"), span_list(F.col("secrets")).alias("spans")
    )
