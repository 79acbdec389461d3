"""Surrogates for personal data: keyed replacements of the same type and format, distinct and the same everywhere.

A surrogate depends on the key, the type and the entity's canonical value alone, and a given name's also on its gender,
which is resolved once over the corpus, so mentions that mean the same get the same one in any document.  A name that a
title tells is replaced wherever the document has it, with or without a title.  All entities of the corpus are checked
together: where two surrogates of a type are equal, or one equals a real entity, all but the smallest get the next
attempt, until none collide; late attempts are longer, so that a type never runs out of them.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from bisect import bisect
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.store import narrow, row_text, save

_PATTERNS = [  # in order of precedence where they overlap
    ("secret", re.compile(r"(?i)\b(?:token|password|passwd|secret|api[_-]?key)\s*[=:]\s*[\"']?([A-Za-z0-9_+/-]{8,})")),
    ("email", re.compile(r"(?<![\w.+-])([\w+-][\w.+-]*@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})(?![\w-])")),
    ("ip", re.compile(r"(?<![\d.])((?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d))(?!\.?\d)")),
    ("iban", re.compile(r"\b([A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?)\b")),
    ("ssn", re.compile(r"(?<![\w-])(\d{3}-\d{2}-\d{4})(?![\w-])")),
    ("phone", re.compile(r"(?<![\w+])(\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}|(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4})(?!\w)")),
    ("card", re.compile(r"(?<![\w.-])(\d{4}([ -]?)\d{4}\2\d{4}\2\d{1,7})(?![\w-])")),
]
#: Titles of the languages covered, by the gender they tell: fixed values.
TITLES = {
    "f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Sra.", "Signora", "Госпожа", "Κυρία"],
    "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "Господин", "Κύριος"],
    "n": ["Dr.", "Dr", "Prof.", "Prof"],
}
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
#: A letter, or a mark that letters carry (combining accents, Hebrew and Arabic points, vowel signs of Indic scripts).
_LETTER = r"(?:[^\W\d_]|[\u0300-\u036f\u0591-\u05bd\u064b-\u065f\u0900-\u0963\u0981-\u0dff])"
_WORD = rf"[^\W\d_a-z]{_LETTER}+(?:-{_LETTER}+)?"
_TITLE = "(?:" + "|".join(re.escape(t) for t in sorted(_GENDER, key=len, reverse=True)) + ")"
_NAME = re.compile(rf"\b({_TITLE}(?: {_TITLE})*) ({_WORD})(?: ({_WORD}))?")
_NAME_WORD = re.compile(rf"(?<![^\W_]){_WORD}")
#: Consonants and vowels of surrogate names by script, and the endings that given names of a gender have.
SCRIPTS = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδκλμνπρστ", "αειου")}
ENDINGS = {"f": {"latin": "a", "cyrillic": "а", "greek": "α"}, "m": {"latin": "n", "cyrillic": "н", "greek": "ς"}, "n": {"latin": "i", "cyrillic": "й", "greek": "ι"}}
#: Attempts after which each further one adds a digit or a syllable.
_SAME_LENGTH = 40


def _script(word: str) -> str:
    for c in word:
        if "Ѐ" <= c <= "ӿ":
            return "cyrillic"
        if "Ͱ" <= c <= "Ͽ":
            return "greek"
    return "latin" if all(unicodedata.name(c, "").startswith("LATIN") for c in word if c != "-") else "other"


@lru_cache(4096)
def _letters_like(c: str) -> str:
    """Letters of the script and class of ``c`` in its 256 code points; for an ideograph or a Hangul syllable, in 4096."""
    script, kind, span = unicodedata.name(c, "").split(" ")[0], unicodedata.category(c), 256
    if script in ("CJK", "HANGUL"):
        span = 4096
    start = ord(c) // span * span
    own = (chr(k) for k in range(max(start, 0x4E00 if c >= "一" else 0), start + span))
    return "".join(x for x in own if unicodedata.category(x) == kind and unicodedata.name(x, "").split(" ")[0] == script and unicodedata.normalize("NFKC", x) == x) or c


def mentions(text: str) -> list[tuple[int, int, str, str]]:
    """(start, end, type, canonical value) of the entities in a text, in order and without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    digits = re.search(r"\d\d", text) is not None
    for kind, pattern in _PATTERNS:
        if kind == "email" and "@" not in text or kind in ("ip", "iban", "ssn", "phone", "card") and not digits or kind == "secret" and "=" not in text and ":" not in text:
            continue
        for m in pattern.finditer(text):
            value = m[1]
            if kind == "iban":
                value = value.replace(" ", "")
            if kind in ("phone", "card", "ssn"):
                value = re.sub(r"\D", "", value)
                if kind == "card" and not 13 <= len(value) <= 19 or kind == "phone" and not 7 <= len(value) <= 15:
                    continue
            found.append((m.start(1), m.end(1), kind, value.lower() if kind == "email" else value))
    found += _names(text)
    out: list[tuple[int, int, str, str]] = []
    rank = {k: i for i, (k, _) in enumerate(_PATTERNS)}
    for e in sorted(found, key=lambda x: (rank.get(x[2], 9), x[0])):
        k = bisect(out, e)
        if (k == 0 or out[k - 1][1] <= e[0]) and (k == len(out) or e[1] <= out[k][0]):
            out.insert(k, e)
    return out


def _majority(told: list[str]) -> str:
    """The gender told more often; n for neither."""
    f, m = told.count("f"), told.count("m")
    return "f" if f > m else "m" if m > f else "n"


def _gender(titles: str) -> str:
    return _majority([_GENDER[t] for t in titles.split(" ")])


def _names(text: str) -> list[tuple[int, int, str, str]]:
    """Mentions of the names that titles tell, then further ones of the same names.

    A given name's type ends in the gender that most of its titles in this text tell.
    """
    titled = list(_NAME.finditer(text))
    if not titled:
        return []
    pairs, told = set(), {}
    for m in titled:
        if m[3]:
            pairs.add((m[2].lower(), m[3].lower()))
            told.setdefault(m[2].lower(), []).append(_gender(m[1]))
    surnames, spans = {s for _, s in pairs}, []
    gender = {g: _majority(x) for g, x in told.items()}
    for m in titled:
        first = m[2].lower()
        # A single name after a title is a surname, unless the text has it as a given name alone and of no other gender.
        is_given = m[3] is not None or first in gender and first not in surnames and {gender[first], _gender(m[1])} != {"f", "m"}
        spans.append((m.start(2), m.end(2), is_given))
        if m[3]:
            spans.append((m.start(3), m.end(3), False))
    surnames |= {text[a:b].lower() for a, b, is_given in spans if not is_given}
    words: list[tuple[int, int]] = []
    for m in _NAME_WORD.finditer(text):
        if m[0].lower() in gender or m[0].lower() in surnames or "-" not in m[0]:
            words.append(m.span())
        else:  # a part of a longer word
            cut = m.start() + m[0].index("-")
            words += [(m.start(), cut), (cut + 1, m.end())]
    for k, (a, b) in enumerate(words):
        word = text[a:b].lower()
        if word not in gender and word not in surnames or text[a].islower():
            continue
        after = text[words[k + 1][0]:words[k + 1][1]].lower() if k + 1 < len(words) and text[b:words[k + 1][0]].isspace() else None
        spans.append((a, b, word not in surnames or (word, after) in pairs))
    return [(a, b, f"given-{gender[text[a:b].lower()]}" if is_given else "surname", text[a:b].lower()) for a, b, is_given in spans]


def _stream(key: bytes, *parts: object) -> Callable[[int], int]:
    """Keyed numbers below what is asked for."""
    seed, state = "\0".join(map(str, parts)).encode(), [0, b""]

    def below(n: int) -> int:
        if len(state[1]) < 4:
            state[1] = hmac.new(key, b"%d\0" % state[0] + seed, hashlib.sha256).digest()
            state[0] += 1
        value, state[1] = int.from_bytes(state[1][:4], "big"), state[1][4:]
        return value % n

    return below


def _alike(value: str, below: Callable[[int], int], hexadecimal: bool = False) -> str:
    """Digits for digits, letters for letters of the same case; a leading digit that isn't 0 stays so."""
    out = []
    for k, c in enumerate(value):
        if c.isascii() and c.isdigit():
            out.append(str(1 + below(9)) if k == 0 and c != "0" else str(below(10)))
        elif c.isalpha():
            low = "abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"
            out.append(low[below(len(low))].upper() if c.isupper() else low[below(len(low))])
        else:
            out.append(c)
    return "".join(out)


def _luhn(digits: str) -> int:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 else 1)
        total += d - 9 if d > 9 else d
    return total % 10


def surrogate(key: bytes, kind: str, value: str, attempt: int = 0) -> str:
    """The canonical surrogate of a canonical value."""
    below = _stream(key, kind.partition("-")[0], attempt, value)
    more = max(0, attempt - _SAME_LENGTH)
    longer = "".join(str(below(10)) for _ in range(more))
    if kind == "email":
        local, _, domain = value.partition("@")
        *labels, top = domain.split(".")
        shared = _stream(key, "domain", domain)  # one domain, one surrogate
        return f"{_alike(local, below)}{longer}@{'.'.join(_alike(x, shared) for x in labels)}.{top}"
    if kind == "ip":
        return ".".join(str(1 + below(254)) for _ in range(4))
    if kind == "card":
        body = value[0] + _alike(value[1:-1], below) + longer
        if _luhn(value):
            return body + str(below(10))
        return body + next(str(d) for d in range(10) if not _luhn(body + str(d)))
    if kind == "phone":
        return value[0] + _alike(value[1:], below) + longer
    if kind in ("iban", "ssn"):
        kept = 2 * (kind == "iban")  # the country
        return value[:kept] + _alike(value[kept:], below) + longer
    if kind == "secret":
        return _alike(value, below, re.fullmatch(r"[0-9a-fA-F]+", value) is not None) + longer
    script = _script(value)
    if script == "other":  # letter for letter; these scripts have no endings that tell a gender here
        own = value + value[-1] * (max(0, attempt - 3) // 4)
        return "".join(x[below(len(x))] if (x := _letters_like(c)) and c != "-" else c for c in own)
    # Names: syllables of the script, as long as the name or a little longer.
    consonants, vowels = SCRIPTS[script]
    size = max(2, (len(value) + 1) // 2 + below(2) + (attempt > 3) + more)
    name = "".join(consonants[below(len(consonants))] + vowels[below(len(vowels))] for _ in range(size))
    gender = kind.removeprefix("given-")
    return name + ENDINGS[gender][script] if gender in ENDINGS and gender != "f" else name[:-1] + ENDINGS["f"][script] if gender == "f" else name


def render(shown: str, kind: str, replacement: str) -> str:
    """The surrogate in the format of a mention: its separators or its case."""
    if kind in ("phone", "card", "ssn", "iban"):
        marks = iter(replacement)
        return "".join([*(next(marks) if c.isdigit() or kind == "iban" and c != " " else c for c in shown), *marks])
    if kind == "email":
        return replacement.upper() if shown.isupper() else replacement
    if kind == "surname" or kind.startswith("given-"):
        return replacement.upper() if shown.isupper() else replacement[0].upper() + replacement[1:]
    return replacement


def _mentioned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in row_text(batch):
            text = text.as_py()
            own = {e[2:] for e in mentions(text)}
            if own:
                digest = hashlib.md5(text.encode()).hexdigest()
                rows += [(digest, *e) for e in own]
        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.string()) for k in range(3)], ["digest", "kind", "value"])


def _tried(key: bytes):
    def run(batches):
        for batch in batches:
            own = [surrogate(key, *r) for r in zip(*(batch.column(c).to_pylist() for c in ("kind", "value", "attempt")))]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("kind", "value", "attempt")), pa.array(own, pa.string())], ["kind", "value", "attempt", "surrogate"])

    return run


def assign(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, attempt, surrogate) for distinct (kind, value): no two surrogates of a kind are equal, none is real.

    Given names of any gender are one kind here; each must come with one gender.  Only an IPv4 address can't grow: the
    attempts go on while there are free ones.
    """
    schema = "kind string, value string, attempt int, surrogate string"
    family = F.substring_index("kind", "-", 1).alias("family")
    tried = save(entities.withColumn("attempt", F.lit(0)).mapInArrow(_tried(key), schema), "surrogates")
    real = entities.select(family, F.col("value").alias("surrogate"), F.lit(True).alias("real"))
    while True:
        # An attempt that has stood longest keeps its surrogate.
        order = Window.partitionBy("family", "surrogate").orderBy("attempt", "value")
        marked = tried.withColumn("family", family).join(real, ["family", "surrogate"], "left").withColumn("again", F.col("real").isNotNull() | (F.row_number().over(order) > 1))
        marked = save(marked.select("kind", "value", "attempt", "surrogate", "again"), "marked")
        if not marked.filter("again").limit(1).count():
            return marked.drop("again")
        again = marked.filter("again").select("kind", "value", (F.col("attempt") + 1).alias("attempt")).mapInArrow(_tried(key), schema)
        tried = marked.filter("NOT again").drop("again").unionByName(again)


def _replace(key: bytes):
    def run(batches):
        for batch in batches:
            out, counts = [], []
            lists = batch.column("__known").to_pylist()
            for text, special in zip(batch.column("text"), lists):
                text = text.as_py()
                known = {(s["kind"], s["value"]): (s["same"], s["attempt"]) for s in special or ()}
                at, parts, found = 0, [], mentions(text or "")
                for start, end, kind, value in found:
                    same, attempt = known.get((kind, value), (kind, 0))
                    parts += [text[at:start], render(text[start:end], same, surrogate(key, same, value, attempt))]
                    at = end
                out.append("".join([*parts, text[at:]]) if found else text)
                counts.append(len(found))
            place = batch.schema.get_field_index("text")
            batch = batch.set_column(place, "text", pa.array(out, batch.schema.field(place).type))
            yield batch.drop_columns(["__known"]).append_column("n_entities", pa.array(counts, pa.int64()))

    return run


def _resolved(found: DataFrame) -> DataFrame:
    """``found`` with the corpus's type of each entity as ``same``: a given name has the gender that most documents tell."""
    votes = found.filter("kind LIKE 'given-%'").groupBy("value").agg(
        F.sum(F.expr("CASE kind WHEN 'given-f' THEN 1 WHEN 'given-m' THEN -1 ELSE 0 END")).alias("f"), F.min("kind").alias("lo"), F.max("kind").alias("hi"))
    # Where all documents agree, nothing has to be looked up.
    mixed = votes.filter("lo <> hi").select(
        F.col("value").alias("name"), F.expr("CASE WHEN f > 0 THEN 'given-f' WHEN f < 0 THEN 'given-m' ELSE 'given-n' END").alias("told"))
    mixed = save(mixed, "genders")
    name = F.expr("CASE WHEN kind LIKE 'given-%' THEN value END")
    return found.join(narrow(mixed), name == F.col("name"), "left").select("digest", "kind", "value", F.coalesce("told", "kind").alias("same"))


def with_surrogates(docs: DataFrame, key: bytes) -> DataFrame:
    """doc_id, text, n_entities of each row of ``docs`` (doc_id, text), entities replaced.

    Null and empty texts stay as they are; rows may repeat, ids may be null, texts are read as a whole; other columns are
    not read.  Only entities whose first surrogate collided, and given names whose text tells another gender than the
    corpus, need a look-up; these travel as short lists with the texts that mention them, one list a text, whatever its ids.
    """
    docs = docs.select("doc_id", "text")
    found = _resolved(save(docs.mapInArrow(_mentioned, "digest string, kind string, value string"), "mentions"))
    entities = found.select(F.col("same").alias("kind"), "value").distinct()
    moved = save(assign(entities, key).filter("attempt > 0").select(F.col("kind").alias("same"), "value", "attempt"), "moved")
    known = found.join(narrow(moved), ["same", "value"], "left").filter("attempt IS NOT NULL OR same <> kind")
    known = known.groupBy("digest").agg(F.collect_set(F.struct("kind", "value", "same", F.coalesce("attempt", F.lit(0)).alias("attempt"))).alias("__known"))
    lists = save(known, "known")
    rows, entries = lists.agg(F.count("*"), F.sum(F.size("__known"))).first()
    lists = narrow(lists, rows + 4 * (entries or 0))  # an entry takes the memory of some narrow rows
    wide = docs.join(lists, F.md5(docs.text.cast("binary")) == lists.digest, "left").select(docs.doc_id, "text", "__known")
    return wide.mapInArrow(_replace(key), "doc_id long, text string, n_entities long")
