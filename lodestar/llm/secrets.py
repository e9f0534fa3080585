"""Secret scans by dictionary-primed compression novelty.

Pattern matches of three kinds (assignments, access ids, long hex strings) are always reported. Beside
them, a string in a sensitive context (a word such as "password" or "bearer" shortly before it) is a
candidate. The zstandard compressor, primed with a dictionary of identifiers and configuration idioms,
compresses the text around the candidate with and without it; the difference is the candidate's marginal
size. A candidate that costs nearly as many bytes as random characters of its alphabet is reported
as kind ``novel``; identifiers, prose and repeated text compress and are left alone. Short words are stored
by zstandard as they are, so a candidate of letters must also cost as many bits as random letters under the
letter pairs of frequent words. Each reported string extends the context, and the lines of a private key
block are measured together, up to its end line.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import slices, worker_cache

ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex")
NOVEL = "novel"
#: Words that make what follows sensitive.
SENSITIVE = re.compile(r"pass(?:word|wd|phrase)|secret|token|api[_ -]?key|private[_ -]?key|credential|bearer|authorization|client[_ -]?id|connection[_ -]?string", re.ASCII | re.IGNORECASE)
SENSITIVE_HINTS = ("pass", "secret", "token", "api", "private", "credential", "bearer", "authorization", "client", "connection")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
#: Head and end of a private key block; lines, also between escaped line ends; a line of key data.
BLOCK, BLOCK_END = re.compile(r"-----BEGIN [A-Z0-9 ]{0,40}PRIVATE KEY(?: BLOCK)?-----"), "-----END"
LINE, KEY_LINE = re.compile(r"(?:(?!\\[nr])[^\r\n])+"), re.compile(r"\s*(?:\\[nr])?([A-Za-z0-9+/=_-]+)\s*")
#: Characters after a sensitive word or a reported string in which candidates are looked for, and around a candidate as its context.
REACH, AROUND = 48, 512
#: Marginal compressed bits per bit of the alphabet's entropy from which a candidate is novel.
NOVELTY = 0.8
#: Bits a letter under letter pairs, and for each change of case, from which letters are random.
LETTER_BITS, CASE_BITS = math.log2(26), 1.5

#: What the compressor is primed with: idioms of code and configuration, and frequent identifiers.
DICTIONARY = "\n".join(
    [
        "password = os.environ['PASSWORD']; passwd: changeme; secret_key = settings.SECRET_KEY; token = request.headers.get('Authorization')",
        "api_key: ${API_KEY}; apikey=your_api_key_here; export AWS_ACCESS_KEY_ID= AWS_SECRET_ACCESS_KEY= client_id client_secret access_token refresh_token",
        "Authorization: Bearer token; username password host port database connection_string user id example placeholder xxxxxxxxxxxx 000000000000 1234567890",
        "def get_password(self): return self.password; private static final String TOKEN_NAME; const authenticationService = createAuthenticationService(configuration)",
        "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 authenticate authorization credential configuration environment variable parameter",
        "https://www.example.com/index.html?id= file path name value key type string integer boolean default description license copyright version",
    ]
).encode()


#: Frequent words and endings of four languages, whose letter pairs tell words from random letters.
WORDS = """the of and to in that is was for with as his they at be this have from or one had by word but not what all were we when your can said there use an each which she do how their if will
up other about out many then them these so some her would make like him into time has look two more write go see number no way could people my than first water been call who now find long down day
did get come made may part information international government development management application understanding organization environment characteristics something different between important
education community technology following experience university production available performance responsibility knowledge particularly relationship straightforward through though thought
der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über einen so zum war haben nur
oder aber vor zur bis mehr durch man sein wurde sei wahrscheinlichkeit geschwindigkeit versicherung gesellschaft entwicklung verantwortung rechtsprechung verordnung wissenschaft möglichkeiten grundlage
le la les et des est une que dans pour qui sur pas plus par je avec tout faire son mettre autre on mais nous comme ou si leur être deux même aussi bien cette fait développement gouvernement
particulièrement responsable organisation constitutionnel entreprise connaissance différent
el que los se del las un por con no una su para es al lo como más pero sus le ya este sí porque esta entre cuando muy sin sobre también hasta hay donde desarrolladores responsabilidades conocimiento
información universidad diferente gobierno organización administración password configuration authentication request response element factory create default variable value string""".lower().split()


def letter_costs() -> list[list[float]]:
    """Bits of a letter a-z after a letter, of the pairs in ``WORDS``; half a pair is added to each count."""
    counts = [[0.5] * 26 for _ in range(26)]
    for word in WORDS:
        for a, b in zip(word, word[1:], strict=False):
            if a in LETTERS and b in LETTERS:
                counts[LETTERS[a]][LETTERS[b]] += 1
    return [[-math.log2(x / sum(row)) for x in row] for row in counts]


LETTERS = {c: i for i, c in enumerate("abcdefghijklmnopqrstuvwxyz")}
LETTER_COSTS = letter_costs()


def letter_bits(x: str) -> float:
    """Bits a letter pair of the letters in ``x``, changes of case included; 0 without pairs."""
    bits = n = 0
    for a, b in zip(x, x[1:], strict=False):
        i, j = LETTERS.get(a.lower()), LETTERS.get(b.lower())
        if i is not None and j is not None:
            bits += LETTER_COSTS[i][j] + CASE_BITS * (a.isupper() != b.isupper())
            n += 1
    return bits / n if n else 0.0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the pattern matches, in order."""
    found = []
    low = text.lower()
    if any(x in low for x in ("pass", "secret", "token", "key")):
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


class Novelty:
    """Marginal compressed size of strings in their context."""

    def __init__(self):
        self.compressor = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(DICTIONARY, dict_type=zstandard.DICT_TYPE_RAWCONTENT))

    def of(self, text: str, start: int, end: int) -> float:
        """Marginal bits of text[start:end] over the bits of random characters of its alphabet."""
        before, candidate, after = text[max(0, start - AROUND) : start].encode(), text[start:end].encode(), text[end : end + AROUND].encode()
        extra = len(self.compressor.compress(before + candidate + after)) - len(self.compressor.compress(before + after))
        size = 16 if re.fullmatch(rb"[0-9a-f]+|[0-9A-F]+", candidate) else sum(n for n, p in ((10, rb"[0-9]"), (26, rb"[a-z]"), (26, rb"[A-Z]"), (4, rb"[+/_=-]")) if re.search(p, candidate))
        return 8 * extra / (len(candidate) * math.log2(size))


def is_novel(text: str, start: int, end: int, novelty: Novelty) -> bool:
    x = text[start:end]
    if not any(c.isdigit() for c in x) and letter_bits(x) < LETTER_BITS:
        return False
    return novelty.of(text, start, end) >= NOVELTY


def block_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    """(start, end) of the lines of private key blocks whose data is incompressible, outside the base spans."""
    found, heads = [], [(m.start(), m.end()) for m in BLOCK.finditer(text)]
    for k, (_, at) in enumerate(heads):
        last = heads[k + 1][0] if k + 1 < len(heads) else len(text)
        end = text.find(BLOCK_END, at, last)
        if end < 0:
            continue
        lines = [m.span(1) for line in LINE.finditer(text, at, end) if (m := KEY_LINE.fullmatch(text, *line.span()))]
        data = "".join(text[s:e] for s, e in lines)
        if len(data) < 12 or not is_novel(data, 0, len(data), novelty):
            continue
        for s, e in lines:
            for low, _, high in base:
                if low < e and s < high:
                    if s < low:
                        found.append((s, low))
                    s = min(e, high)
            if s < e:
                found.append((s, e))
    return found


def novel_spans(text: str, base: list[tuple[int, int, int]], novelty: Novelty) -> list[tuple[int, int]]:
    """(start, end) of further incompressible strings in a sensitive context, outside the base spans."""
    low = text.lower()
    if not any(x in low for x in SENSITIVE_HINTS):
        return []
    found, done = block_spans(text, base, novelty) if "-----BEGIN " in text else [], 0
    known = sorted([(s, e) for s, _, e in base] + found)
    for word in SENSITIVE.finditer(text):
        at, limit = max(word.end(), done), word.end() + REACH
        while (m := CANDIDATE.search(text, at)) and m.start() < limit:
            at = done = m.end()
            reported = any(s < m.end() and m.start() < e for s, e in known)
            if not reported and is_novel(text, m.start(), m.end(), novelty):
                found.append((m.start(), m.end()))
                reported = True
            if reported:
                limit = max(limit, m.end() + REACH)
    return sorted(found)


def scan(text: str, novelty: Novelty) -> tuple[list[tuple[int, int, int]], list[tuple[int, int]]]:
    base = base_spans(text)
    return base, novel_spans(text, base, novelty)


FOUND = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_novel long"


def _digest(spans: list[tuple[int, int, int]], names: tuple[str, ...]) -> str:
    return ",".join(f"{names[k]}:{s}:{e}" for s, k, e in spans)


def scan_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Arrow function: what is found in each text."""
    novelty, names = worker_cache("novelty", Novelty), (*KINDS, NOVEL)
    for batch in slices(batches):
        rows = []
        for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            base, novel = scan(text or "", novelty)
            every = sorted(base + [(s, 3, e) for s, e in novel])
            rows.append((doc, *(sum(x[1] == k for x in base) for k in range(3)), hashlib.sha256(_digest(base, names).encode()).hexdigest(), _digest(every, names), len(novel)))
        kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.int64()]
        columns = list(zip(*rows, strict=True)) or [()] * 7
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds, strict=True)], names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"])


def secret_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_novel), one for each input row.

    Spans are ``kind:start:end`` in code points, end exclusive, in order of start. A null text is an
    empty one; texts without secrets have zero counts, empty spans and the digest of the empty string.
    Null ids stay null, repeated rows stay, an empty table gives no rows, other columns are not read.
    """
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan_rows, FOUND)


def redact_rows(mark: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = worker_cache("novelty", Novelty)
        for batch in slices(batches):
            texts = []
            for text in batch.column("text").to_pylist():
                if text:
                    base, novel = scan(text, novelty)
                    out, at = [], 0
                    for s, e in sorted([(s, e) for s, _, e in base] + novel):
                        if e > at:
                            out += [text[at : max(s, at)], mark if s >= at else ""]
                            at = e
                    text = "".join([*out, text[at:]]) if out else text
                texts.append(text)
            at = batch.schema.get_field_index("text")
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return run


def redact_secrets(docs: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """``docs`` with every span in its column ``text`` replaced by ``mark``; all rows and columns stay."""
    return docs.mapInArrow(redact_rows(mark), docs.schema)
