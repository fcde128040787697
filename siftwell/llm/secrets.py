"""Secret scans (operator 3): fixed patterns, and Markov models of random strings against ordinary identifiers."""

from __future__ import annotations

import hashlib
import re
import string
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftwell.llm.common import BATCH_ROWS, smallest, spread, table

ASSIGN = re.compile(r"""((?ai:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
#: What every assignment contains, found faster than the keyword.
ASSIGN_CUE = re.compile(r"(?ai:passw|secret|token|api_?key)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{12,}")
HEX = re.compile(r"(?<![0-9a-f])[0-9a-f]{32,}")
#: Letters of a random string at least.
LEAST = 16
CANDIDATE = re.compile(rf"[A-Za-z0-9+/_=-]{{{LEAST},}}")
PIECE = re.compile(rf"[A-Za-z0-9]{{{LEAST},}}")
KINDS = ("assign", "access", "hex", "random")
#: Documents, those with the smallest hash of the doc_id, whose words and secrets are the labelled samples.
FIT_DOCS = 2_000
#: Random strings, and as many numbers, made with a fixed seed, that join the labelled ones.
MADE = 2_000
#: Log-likelihood ratio a letter, and in all, from which a candidate is a secret.
PER_LETTER, IN_ALL = 0.5, 14.0
#: Weight, in transitions, of the characters' own frequency in the estimate after a character, and the share of that
#: which all characters have alike, so that marks a corpus lacks don't alone make a secret.
BACKOFF, ALIKE = 5.0, 0.2
#: Share of an ordinary transition's count that its capital forms get.
SHARED = 0.3
#: Share of a small letter's ordinary transitions that go to the capital of a next word.
CAMEL = 0.05
ALPHABET = string.ascii_lowercase + string.ascii_uppercase + string.digits + "+/_=-"
#: Words of which names of programs are made, whatever the language of a corpus; samples of the ordinary model.
COMMON = (
    "abstract account action application array buffer button cache channel class client config connection constant content context control count create current database default delete description "
    "device directory document element encoding error event example factory field file filter format function handler header image index information interface internal language length library "
    "local long machine manager member memory message method module name network number object option output package parameter password path position process program property protocol provider query "
    "reader record reference register request resource response result schedule section server service session setting signal source state status storage string structure system table template "
    "thread timeout token transaction translation update user value variable version window writer"
).split()
NUMBER = {c: k for k, c in enumerate(ALPHABET)}


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, end, kind number) of the fixed patterns' matches, in code points, by start and kind."""
    found = []
    if ASSIGN_CUE.search(text):
        found += [(m.start(), m.end(), 0) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
    found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[0], s[2]))


def secret_of(text: str, span: tuple[int, int, int]) -> str:
    m = ASSIGN.match(text, span[0]) if span[2] == 0 else None
    return m[2] if m else text[span[0] : span[1]]


def coded(s: str) -> np.ndarray:
    return np.array([NUMBER[c] for c in s if c in NUMBER], np.int64)


def made_strings() -> list[str]:
    """Random strings over the alphabets of keys: hexadecimal, letters and digits, base 64, capitals and digits."""
    rng = np.random.default_rng(3)
    kinds = ["0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_uppercase + string.digits, string.ascii_letters + string.digits + "_-"]
    return ["".join(rng.choice(list(kinds[k % len(kinds)]), int(rng.integers(16, 64)))) for k in range(MADE)]


class Ratio:
    """Log-likelihood ratio of a random-string model over an identifier model."""

    def __init__(self, table: np.ndarray):
        self.table = table

    def __call__(self, s: str) -> float:
        c = coded(s)
        return float(self.table[len(ALPHABET), c[0]] + self.table[c[:-1], c[1:]].sum()) if len(c) else 0.0

    def random(self, s: str) -> bool:
        r = self(s) if len(s) >= LEAST else 0.0
        return r >= IN_ALL and r >= PER_LETTER * len(s)

    def spans(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """What the ratio takes for secrets outside of the base spans, which are sorted.

        Runs of key characters are cut at base spans; a part counts whole, else its pieces between separators do, so that
        neither a path before a key nor a known secret beside it hides one.
        """
        found, k = [], 0
        for m in CANDIDATE.finditer(text):
            while k < len(base) and base[k][1] <= m.start():
                k += 1
            at, j, parts = m.start(), k, []
            while j < len(base) and base[j][0] < m.end():
                parts.append((at, base[j][0]))
                at, j = max(at, base[j][1]), j + 1
            for a, b in [*parts, (at, m.end())]:
                if b - a < LEAST:
                    continue
                if self.random(text[a:b]):
                    found.append((a, b, 3))
                else:
                    found += [(a + p.start(), a + p.end(), 3) for p in PIECE.finditer(text[a:b]) if self.random(p[0])]
        return found


def ordinary_strings() -> list[str]:
    """Names, numbers and rulers, made with a fixed seed: ordinary runs of key characters that a corpus of prose lacks."""
    rng = np.random.default_rng(5)
    digits = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    names = [x for _ in range(20) for x in identifiers(list(rng.permutation(COMMON)))] + [f"{a}{b.title()}{c.title()}" for a, b, c in (rng.choice(COMMON, 3) for _ in range(MADE))]
    out = names + [digits(int(rng.integers(4, 30))) for _ in range(MADE)]
    out += [f"{digits(4)}-{digits(2)}-{digits(2)}" for _ in range(MADE // 4)] + [digits(3) + "-" + digits(3) + "-" + digits(4) for _ in range(MADE // 4)]
    return out + [c * int(rng.integers(16, 80)) for c in ALPHABET for _ in range(20)]


def identifiers(words: list[str]) -> list[str]:
    """Ordinary identifiers in the usual spellings, each of two words and some with a number: prose holds few."""
    order = sorted(words, key=lambda w: zlib.crc32(w.encode())) if words == sorted(words) else words
    out = []
    for k, (a, b) in enumerate(zip(order, order[1:])):
        a, b = a.lower(), b.lower()
        out.append((f"{a}_{b}", f"{a}{b.title()}", f"{a.title()}{b.title()}", f"{a.upper()}_{b.upper()}", f"{a}-{b}", f"/{a}/{b}", f"{a}={b}", f"{a}_{k % 100}", f"{a}{k % 10}", f"{a}{b}")[k % 10])
    return out


def fitted(docs: DataFrame) -> Ratio:
    """Models of a bounded sample: secrets by the fixed patterns and made strings, against the other words."""
    sample = smallest(docs.where("doc_id IS NOT NULL").select("doc_id"), "doc_id", FIT_DOCS).distinct()
    words = docs.join(F.broadcast(sample), "doc_id").select("text")

    def labelled(batches):
        for batch in batches:
            rows = set()
            for text in batch.column(0).to_pylist():
                if not text:
                    continue
                base = base_spans(text)
                rows |= {(secret_of(text, s), 1) for s in base}
                rest = list(text)
                for a, b, _ in base:
                    rest[a:b] = " " * (b - a)
                # A long word with digits may be a secret that no pattern knows, so it is no ordinary sample.
                own = {w for w in re.findall(r"[A-Za-z0-9_-]{2,}", "".join(rest)) if re.search("[A-Za-z]", w) and (len(w) < LEAST or not re.search("[0-9]", w))}
                rows |= {(w, 0) for w in own} | {(x, 0) for x in identifiers(sorted(w for w in own if w.isalpha()))}
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32())], ["word", "label"])

    # Counts of transitions are small whatever the sample holds, so only they reach the driver.
    pairs = words.mapInArrow(labelled, "word string, label int").distinct()
    steps = pairs.select("label", F.explode(F.expr("transform(sequence(0, length(word) - 1), i -> substring(word, greatest(i, 1), if(i = 0, 1, 2)))")).alias("step")).where("length(step) > 0").groupBy("label", "step").count().collect()
    k = len(ALPHABET)
    n = np.zeros((2, k + 1, k))  # label, character before (the last row: none), character
    for label, strings in ((1, made_strings()), (0, ordinary_strings())):
        for s in strings:
            c = coded(s)
            n[label, k, c[0]] += 1
            np.add.at(n[label], (c[:-1], c[1:]), 1)
    for label, step, count in steps:
        if all(c in NUMBER for c in step):
            # Ordinary letters follow one another in names of any case, which prose seldom shows.
            for form, weight in ((step, 1.0), (step.title(), SHARED), (step.upper(), SHARED)) if label == 0 else ((step, 1.0),):
                n[label, NUMBER[form[0]] if len(form) == 2 else k, NUMBER[form[-1]]] += weight * count
    # A capital may begin a word after any small letter, as often as words begin with it.
    small, capital = (slice(c, c + 26) for c in (0, 26))
    begins = n[0, k, small] + n[0, k, capital] + 1.0
    n[0, small, capital] += CAMEL * n[0, small].sum(1, keepdims=True) * begins / begins.sum()
    alone = n.sum(1, keepdims=True) + 0.5
    alone = (1 - ALIKE) * alone / alone.sum(2, keepdims=True) + ALIKE / k
    p = np.log((n + BACKOFF * alone) / (n.sum(2, keepdims=True) + BACKOFF))
    return Ratio(p[1] - p[0])


def scan(docs: DataFrame, ratio: Ratio) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans) of each row, its whole text scanned."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, BATCH_ROWS):
                batch = whole.slice(at, BATCH_ROWS)
                out: list[list] = [[] for _ in range(6)]
                for text in batch.column(1).to_pylist():
                    text = text or ""
                    base = base_spans(text)
                    every = sorted(base + ratio.spans(text, base), key=lambda s: (s[0], s[2]))
                    told = [",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans) for spans in (base, every)]
                    for k in range(4):
                        out[k].append(sum(s[2] == k for s in every))
                    out[4].append(hashlib.sha256(told[0].encode()).hexdigest())
                    out[5].append(told[1])
                kinds = [pa.int64()] * 4 + [pa.string()] * 2
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(out, kinds))], ["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string")


def secret_spans(docs: DataFrame) -> DataFrame:
    """Scans each row of ``docs`` (doc_id, text; other columns are ignored) for secrets.

    The fixed patterns' matches stay as they are; other runs of 16 or more key characters, what is left of one beside
    a base span, and pieces of one between separators join as kind ``random`` if a first-order character model of random
    strings explains them better than one of ordinary identifiers by the log-likelihood ratio. The models are fitted on
    the secrets and words of at most FIT_DOCS documents, on MADE random strings and on made numbers. Null and empty texts
    have no span (the digest is of the empty string), texts of any length are scanned whole in linear time, spans of one
    start come in the order of their kinds, repeated rows are scanned alike, an empty table gives no rows. Positions are
    code points.
    """
    return scan(docs, fitted(docs))


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """``docs`` with every span of ``secret_spans`` replaced by ``mark``; null texts stay null."""
    ratio = fitted(docs)

    def run(batches):
        for batch in batches:
            at = batch.schema.get_field_index("text")
            texts = []
            for text in batch.column(at).to_pylist():
                if text:
                    base = base_spans(text)
                    last, parts = 0, []
                    for a, b, _ in sorted(base + ratio.spans(text, base)):
                        if a >= last:
                            parts += [text[last:a], mark]
                        last = max(last, b)
                    text = "".join([*parts, text[last:]])
                texts.append(text)
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return docs.mapInArrow(run, docs.schema)


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts by kind, base_sha256 and spans of every document."""
    return secret_spans(spread(table(spark, sf_dir, "documents"))).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")
