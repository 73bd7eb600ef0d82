"""Secrets in texts: fixed patterns, and incompressible strings in sensitive contexts.

Candidates are long runs of letters, digits and a few signs that stand shortly after a word like ``password``
or ``bearer``. Each is measured by zstandard: the bytes that it adds when it is compressed after the code
around it and a list of common identifiers, with a dictionary of further identifiers primed before both.
Words of the surroundings, known identifiers and repeated patterns cost little, other words about 0.7 bytes a
letter; keys and tokens cost a byte a character or more, for the code lengths are those of identifiers, in
which digits and capitals are rare. A candidate that adds at least ``COST`` bytes a character is reported
beside the spans of the fixed patterns, which always stay.

Identifiers are gathered from the surroundings of all candidates of the whole table: words by the number
of texts that hold them there, never parts of candidates themselves. A dictionary has a fixed size by its
nature (``DICTIONARY_BYTES``): the commonest words, ties by alphabet.

Spark makes one pass for the identifiers, whose counts are summed before the shuffle, and one for the spans;
no text is shuffled. A table without candidates gathers none.

Defined cases: a null text is an empty one, without spans; offsets count code points, ends are exclusive;
texts are searched whole, whatever their length; patterns of one kind do not overlap each other, those of
different kinds may; candidates that touch a pattern's span are left to it; other columns stay, a column
named like the result is replaced.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf

# Kinds in the order in which equal starts are listed, their patterns, the group that is
# measured, and its least length.
PATTERNS = (
    (
        "assign",
        r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        re.ASCII | re.IGNORECASE,
        2,
        8,
    ),
    ("access", r"AKIA[A-Z0-9]+", 0, 0, 16),
    ("hex", r"[0-9a-f]+", 0, 0, 32),
)
NOVEL = "novel"

# Words after which a string may be a secret, and user names in addresses with a password.
SENSITIVE = (
    r"pass(?:word|wd|phrase|code)?\b|pwd\b|secret|token|bearer|credential|auth(?:orization)?\b"
    r"|(?:api|access|private|secret|encryption|signing|account)[ _-]?key|://[^\s/:@]+:"
)
CANDIDATE = r"[A-Za-z0-9][A-Za-z0-9+/_.=~-]{14,}[A-Za-z0-9=]"
REACH = 48  # code points in which a sensitive word ends before a candidate
AROUND = 160  # code points of code on either side that a candidate is compared with
COST = 0.83  # added bytes a character; random letters and digits cost about 0.84 to 1.5
DICTIONARY_BYTES = 32 << 10
LEVEL = 3

# Identifiers that are known without any table.
IDENTIFIERS = """
access account action address admin api application argument array assert attribute auth backend base bearer
block body boolean branch build bytes certificate check child client close cloud code collection column
command comment config console container content context copy count create credential data database date debug
default define delete description device dictionary directory document domain email encode encrypt endpoint
entity environment error example false field file final first format from function generate group header host
http https image import init input insert integer interface internal item java javascript json kernel key
label language length level link list load local location lock logger login main manager message method model
name network node number object order owner package parameter parent parse passphrase password path pattern
platform policy port private process production profile project property provider public query read record
reference release remote request reset resource response result return sample schema script secret section
security server service setting signature size source state status storage string system table target task
template test text thread time timeout token true type update upload user username valid value variable
version view webhook window worker write zone
"""

_BASE = tuple((kind, re.compile(p, flags), group, least) for kind, p, flags, group, least in PATTERNS)
# Maximal runs of hexadecimal digits that are long enough; shorter ones only cost time.
_LONG_HEX = re.compile(r"[0-9a-f]{32,}")
_SENSITIVE = re.compile(SENSITIVE, re.ASCII | re.IGNORECASE)
_CANDIDATE = re.compile(CANDIDATE)
_WORD = re.compile(r"[A-Za-z]{3,}")
# Texts without any of these have neither spans nor candidates.
_ANY = r"(?i:pass|pwd|secret|token|api_?key|bearer|credential|auth|[ _-]?key|://)|AKIA|[0-9a-f]{32}"

_SPAN = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("cost", pa.float64())]
)
SPANS = "array<struct<kind: string, start: int, end: int, cost: double>>"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the fixed patterns, by start, then in the order of the kinds."""
    found = []
    for order, (kind, pattern, group, least) in enumerate(_BASE):
        for match in (_LONG_HEX if kind == "hex" else pattern).finditer(text):
            if match.end(group) - match.start(group) >= least:
                found.append((match.start(), order, match.end(), kind))
    return [(kind, start, end) for start, _, end, kind in sorted(found)]


def candidates(text: str, base: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """Long mixed runs shortly after a sensitive word, or next to another candidate, clear of base spans."""
    found: list[tuple[int, int]] = []
    words = [match.end() for match in _SENSITIVE.finditer(text)]
    if not words:
        return found
    at = passed = 0
    word = -1
    limit = 0  # a sensitive word before the last span has had its secret
    for match in _CANDIDATE.finditer(text, max(0, words[0])):
        start, end = match.span()
        while passed < len(base) and base[passed][1] < end:
            limit = max(limit, base[passed][2])
            passed += 1
        while at < len(words) and words[at] <= start:
            word = words[at]
            at += 1
        run = match.group()
        if limit > start or text[start - 1 : start] == "@":
            continue
        follows = found and not text[found[-1][1] : start].strip()
        near = word >= limit and start - word <= REACH and word >= (found[-1][1] if found else 0)
        if (near or follows) and any(c.isdigit() for c in run) and any(c.isalpha() for c in run):
            found.append((start, end))
    return found


def surroundings(text: str, start: int, end: int) -> str:
    """Code before and after a candidate, without further copies of it."""
    around = text[max(0, start - AROUND) : start] + text[end : end + AROUND]
    return around.replace(text[start:end], "")


class Novelty:
    """Bytes that a string adds to its surroundings once identifiers are known."""

    def __init__(self, gathered: bytes = b""):
        parameters = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, write_checksum=False, write_content_size=False, write_dict_id=False
        )
        capitals = " ".join(word.capitalize() for word in IDENTIFIERS.split()).encode()
        primed = zstandard.ZstdCompressionDict(
            capitals + b" " + gathered, dict_type=zstandard.DICT_TYPE_RAWCONTENT
        )
        primed.precompute_compress(compression_params=parameters)
        self.compressor = zstandard.ZstdCompressor(compression_params=parameters, dict_data=primed)

    def added(self, around: str, candidate: str) -> int:
        before = f"{IDENTIFIERS}{around}".encode(errors="surrogatepass")
        whole = self.compressor.compress(before + candidate.encode())
        return len(whole) - len(self.compressor.compress(before))


def spans(text: str | None, novelty: Novelty) -> list[tuple[str, int, int, float | None]]:
    """All spans of a text, by start, then by kind with novel ones last."""
    text = text or ""
    base = base_spans(text)
    found = [(kind, start, end, None) for kind, start, end in base]
    for start, end in candidates(text, base):
        run = text[start:end]
        cost = novelty.added(surroundings(text, start, end), run) / len(run)
        if cost >= COST:
            found.append((NOVEL, start, end, cost))
    order = [kind for kind, *_ in PATTERNS] + [NOVEL]
    return sorted(found, key=lambda span: (span[1], order.index(span[0])))


def identifiers(text: str) -> set[str]:
    """Words around the candidates of a text; no word of a candidate or of a base span."""
    base = base_spans(text)
    own = candidates(text, base)
    hidden = sorted([*own, *((start, end) for _, start, end in base)])
    clear, at = [], 0
    for start, end in hidden:
        clear.append(text[at : max(at, start)])
        # A mark of the same length keeps all places.
        clear.append(" " * (end - max(at, start)))
        at = max(at, end)
    clear = "".join([*clear, text[at:]])
    return {word for start, end in own for word in _WORD.findall(surroundings(clear, start, end))}


def _suspect(batch: pa.Array) -> Iterator[tuple[int, str]]:
    """Texts that hold anything to look at, with their places."""
    batch = batch.cast(pa.large_string())
    places = pc.indices_nonzero(pc.fill_null(pc.match_substring_regex(batch, _ANY), False))
    return zip(places.to_pylist(), batch.take(places).to_pylist())


def fit_dictionary(df: DataFrame, text: str = "text", size: int = DICTIONARY_BYTES) -> bytes:
    """The commonest identifiers around candidates, the very commonest last, where zstandard sees them best."""

    def words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = [word for _, one in _suspect(batch.column(0)) for word in sorted(identifiers(one))]
            yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], names=["word"])

    counted = df.select(F.col(text)).mapInArrow(words, "word string").groupBy("word").agg(F.count("*").alias("n"))
    # Every word has three letters and a blank at least, so more words cannot fit.
    chosen = counted.orderBy(F.desc("n"), "word").limit(size // 4).collect()
    held, left = [], size
    for row in chosen:
        if len(row.word) + 1 > left:
            break
        held.append(row.word)
        left -= len(row.word) + 1
    return " ".join(reversed(held)).encode()


def found_spans(text: Column, dictionary: bytes) -> Column:
    """Array of (kind, start, end, cost); cost is null for the fixed patterns."""

    # Declared nondeterministic so that several results of it come from one call.
    @arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        novelty = Novelty(dictionary)
        for batch in batches:
            rows = [[] for _ in range(len(batch))]
            for place, one in _suspect(batch):
                rows[place] = [
                    dict(zip(("kind", "start", "end", "cost"), span)) for span in spans(one, novelty)
                ]
            yield pa.array(rows, pa.list_(_SPAN))

    return scan.asNondeterministic()(text)


def find_secrets(df: DataFrame, dictionary: bytes, text: str = "text", result: str = "secrets") -> DataFrame:
    """Add each text's spans."""
    names = [F.col(f"`{name}`") for name in df.columns if name != result]
    made = df.select(F.struct(*names).alias("row"), found_spans(F.col(text), dictionary).alias("made"))
    return made.select("row.*", F.col("made").alias(result))
