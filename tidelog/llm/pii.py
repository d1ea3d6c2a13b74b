"""Personal data replaced by keyed surrogates of the same kind, script, gender and format.

Every entity's free letters and digits are read as one number in mixed radix (digits by ten, vowels, consonants and each
script's letters by their own sets), and the number is moved by a keyed permutation of that range that leaves nothing in
place. Within a kind and format the surrogate is therefore a one-to-one function of the entity: equal entities get equal
surrogates wherever they stand, different ones different surrogates, with no table to keep. Given names move within the
list of their gender and script. Check digits are made to hold. A pass over all entities checks the
distinctness.
"""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm.common import discard, stored, texts_of

KINDS = ("email", "phone", "ip", "card", "iban", "ssn", "name")
# Patterns of the kinds that have one.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]*\w@(?:[^\W_](?:[\w-]*[^\W_])?\.)+[^\W\d_]{2,}(?![\w-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "ssn": r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])",
    "ip": r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\w]|\.\d)",
    "card": r"(?<![\w.+-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])",
    "phone": r"(?<![\w.])(?:\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}|\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}|\d{3}[.-]\d{3}[.-]\d{4})(?!\w)",
}
# Given names by script or language and gender, and titles by gender.
GIVEN = {
    ("latin", "f"): "Alice Anna Barbara Carla Clara Diana Elena Emma Eva Helen Ines Julia Laura Linda Lucia Maria Marta Nina Paula Rosa Sarah Sofia Susan Teresa Vera".split(),
    ("latin", "m"): "Adam Albert Andreas Bruno Carlos Daniel David Erik Felix Frank George Henry Hugo James John Jorge Karl Lukas Martin Michael Oscar Paul Peter Robert Thomas".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Нина Ольга София".split(),
    ("cyrillic", "m"): "Алексей Борис Виктор Иван Михаил Николай Павел Сергей".split(),
    ("greek", "f"): "Άννα Ελένη Ειρήνη Μαρία Σοφία".split(),
    ("greek", "m"): "Γιώργος Δημήτρης Κώστας Νίκος Πέτρος".split(),
}
TITLES = {"m": "Mr Mister Herr Monsieur Señor Sr Sir".split(), "f": "Mrs Ms Miss Frau Madame Mme Mlle Señora Sra".split(), "": "Dr Prof".split()}
# Sets of letters that stand for each other.
SETS = [
    "0123456789", "aeiou", "bcdfghjklmnpqrstvwxyz", "àáâãäåèéêëìíîïòóôõöùúûü", "çñß",
    "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ", "αεηιουω", "βγδζθκλμνξπρστφχψ", "άέήίόύώ",
]
_SET = {c: s for s in SETS for c in s}


@lru_cache(maxsize=10_000)
def letters_like(c: str) -> str | None:
    """The letters that may stand for a small letter or a figure: its set or, in any other script, those of its kind in its block
    of 128 characters that have a capital if it has one. None for signs."""
    if c in _SET:
        return _SET[c]
    kind = unicodedata.category(c)
    if kind not in ("Ll", "Lo", "Lu", "Lt", "Lm", "Nd"):
        return None
    cased = _capital(c) is not None
    block = [chr(i) for i in range(ord(c) & ~127, (ord(c) & ~127) + 128)]
    out = "".join(x for x in block if x not in _SET and unicodedata.category(x) == kind and (_capital(x) is not None) == cased and _capital(x.lower()[:1]) != x)
    return out if len(out) > 1 else None


def _capital(c: str) -> str | None:
    """The one capital that turns back into the letter; None if there is none."""
    up = "ẞ" if c == "ß" else c.upper()
    return up if len(up) == 1 and up != c and up.lower() == c else None
_WORD = r"[^\W\d_][\w'’]*"
_TITLE = "|".join(sorted((re.escape(t) for ts in TITLES.values() for t in ts), key=len, reverse=True))
_NAMED = re.compile(rf"(?<!\w)(?:({_TITLE})\.?[ ]+)?({_WORD})(?:[ ]+({_WORD}))?")
_GENDER = {t: g for g, ts in TITLES.items() for t in ts}
_LISTED = {n: (script, g) for (script, g), names in GIVEN.items() for n in names}
_FIND = {k: re.compile(p) for k, p in PATTERNS.items()}
#: What some part of every match of a pattern looks like: a phone number in a row or grouped, any other number, an IBAN's start.
_MAY = re.compile(r"\d{3}|@|\d\.\d|\+\d|[A-Z]{2}\d\d")
_GIVEN = re.compile(rf"(?<!\w)(?:(?:{_TITLE})\.?[ ]+{_WORD}|(?:{'|'.join(map(re.escape, _LISTED))})(?!\w))")


def luhn(digits: str) -> int:
    """The check digit that the digits before it call for."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return -total % 10


def mod97(country: str, account: str) -> int:
    return int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


class Permutation:
    """A keyed one-to-one map of 0..size-1 without fixed points: a Feistel network, walked until in range, around a shift."""

    def __init__(self, key: bytes, label: str, size: int) -> None:
        self.key, self.label, self.size = key, label.encode(), size
        self.half = max(1, ((size - 1).bit_length() + 1) // 2)
        self.mask = (1 << self.half) - 1

    def _round(self, i: int, x: int) -> int:
        n = (self.half + 7) // 8
        h = hashlib.blake2b(x.to_bytes(n, "big"), digest_size=min(64, max(n, 8)), key=self.key, person=bytes([i]) + hashlib.blake2b(self.label, digest_size=15).digest())
        return int.from_bytes(h.digest(), "big") & self.mask

    def _once(self, x: int, back: bool) -> int:
        left, right = x >> self.half, x & self.mask
        for i in reversed(range(6)) if back else range(6):
            if back:
                left, right = right ^ self._round(i, left), left
            else:
                left, right = right, left ^ self._round(i, right)
        return left << self.half | right

    def _walk(self, x: int, back: bool) -> int:
        x = self._once(x, back)
        while x >= self.size:
            x = self._once(x, back)
        return x

    def move(self, x: int) -> int:
        if self.size < 2:
            return x
        return self._walk((self._walk(x, False) + 1) % self.size, True)


def moved(text: str, key: bytes, label: str) -> str:
    """Free letters of a text moved within their sets, together; case and all other letters stay."""
    low = [c.lower() if _capital(c.lower()[:1]) == c else c for c in text]
    sets = [letters_like(c) for c in low]
    size, number, shape = 1, 0, []
    for c, s in zip(low, sets, strict=True):
        shape.append(s[0] if s else c)
        if s:
            number, size = number * len(s) + s.index(c), size * len(s)
    number = Permutation(key, f"{label}:{''.join(shape)}", size).move(number)
    out = []
    for c, l, s in zip(reversed(text), reversed(low), reversed(sets), strict=True):
        if s:
            number, i = divmod(number, len(s))
            c = (_capital(s[i]) if c != l else None) or s[i]
        out.append(c)
    return "".join(reversed(out))


def coded(text: str, key: bytes) -> str:
    """A made-up word for the rare value that has no letter which another could stand for."""
    h = int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16, key=key, person=b"coded").digest(), "big")
    out = ""
    for _ in range(12):
        h, a = divmod(h, len(SETS[2]))
        h, b = divmod(h, len(SETS[1]))
        out += SETS[2][a] + SETS[1][b]
    return out.capitalize()


def _refill(shape: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isalnum() else c for c in shape)


def _email(value: str, key: bytes) -> str:
    local, _, domain = value.rpartition("@")
    labels = domain.split(".")
    fixed = 2 if len(labels) > 2 and (len(labels[-2]) <= 3 and len(labels[-1]) == 2 or labels[-2] == "example") else 1
    site = ".".join(labels[:-fixed])
    return f"{moved(local, key, 'local')}@{moved(site, key, 'site')}.{'.'.join(labels[-fixed:])}"


def _phone(value: str, key: bytes) -> str:
    # the country code tells the format, so it stays
    m = re.match(r"\+\d{1,3}(?=[ .(-])", value)
    start = m.end() if m else 0
    digits = "".join(c for c in value[start:] if c.isdigit())
    return value[:start] + _refill(value[start:], moved(digits, key, f"phone:{value[:start]}"))


def _ip(value: str, key: bytes) -> str:
    n = int.from_bytes(bytes(map(int, value.split("."))), "big")
    return ".".join(map(str, Permutation(key, "ip", 1 << 32).move(n).to_bytes(4, "big")))


def _card(value: str, key: bytes) -> str:
    d = "".join(c for c in value if c.isdigit())
    body = d[0] + moved(d[1:-1], key, f"card:{d[0]}")
    return _refill(value, body + str(luhn(body)))


def _iban(value: str, key: bytes) -> str:
    flat = value.replace(" ", "")
    body = moved(flat[4:], key, f"iban:{flat[:2]}")
    return _refill(value, f"{flat[:2]}{98 - mod97(flat[:2], body):02d}{body}")


def _given(name: str, key: bytes) -> str | None:
    found = _LISTED.get(name)
    if not found:
        return None
    names = GIVEN[found]
    return names[Permutation(key, f"given:{found}", len(names)).move(names.index(name))]


def _name(value: str, key: bytes) -> str:
    """Given names move within their list; other names by letters, so that a surname is the same alone and in full."""
    return " ".join(_given(w, key) or _family(w, key) for w in value.split(" "))


def _family(name: str, key: bytes) -> str:
    new = moved(name, key, "family")
    while new in _LISTED:  # stays apart from given names, which are never moved here
        new = moved(new, key, "family")
    return new if new != name or not name else coded(name, key)


SURROGATES: dict[str, Callable[[str, bytes], str]] = {
    "email": _email, "phone": _phone, "ip": _ip, "card": _card, "iban": _iban, "ssn": lambda v, k: moved(v, k, "ssn"), "name": _name,
}


def _names(text: str) -> Iterator[tuple[int, int]]:
    """Names after a title, and listed given names with the capitalised word that follows."""
    for start in _GIVEN.finditer(text):
        m = _NAMED.match(text, start.start())
        if not m:
            continue
        title, first, second = m[1], m[2], m[3]
        listed = first in _LISTED
        if not title and not listed or not first[:1].isupper():
            continue
        if second and second[:1].isupper() and not second.isupper():
            yield m.start(2), m.end(3)
        elif title:
            yield m.start(2), m.end(2)


def find_entities(text: str) -> list[tuple[int, int, str]]:
    """Entities as ``(start, end, kind)``, in order, without overlap: earlier first, then the kind listed first."""
    found: list[tuple[int, int, int, str]] = []
    for i, (kind, pattern) in enumerate(_FIND.items()):
        for m in pattern.finditer(text):
            v = m.group()
            if kind == "iban":
                flat = v.replace(" ", "")
                if not 15 <= len(flat) <= 34 or int(flat[2:4]) != 98 - mod97(flat[:2], flat[4:]):
                    continue
            if kind == "card" and luhn("".join(c for c in v if c.isdigit())[:-1]) != int(v[-1]):
                continue  # some other number
            if kind == "phone" and not 7 <= sum(c.isdigit() for c in v) <= 15:
                continue
            found.append((m.start(), i, m.end(), kind))
    found += [(a, len(_FIND), b, "name") for a, b in _names(text)]
    out: list[tuple[int, int, str]] = []
    for a, _, b, kind in sorted(found):
        if not out or a >= out[-1][1]:
            out.append((a, b, kind))
    return out


@lru_cache(maxsize=100_000)
def surrogate(kind: str, value: str, key: bytes) -> str:
    return SURROGATES[kind](value, key)


def replaced(text: str, key: bytes) -> tuple[str, list[tuple[int, int, str]]]:
    """The text with its entities replaced, and the entities' places in it before."""
    entities = find_entities(text)
    out, at = [], 0
    for a, b, kind in entities:
        out += [text[at:a], surrogate(kind, text[a:b], key)]
        at = b
    return "".join([*out, text[at:]]), entities


def _quick(text: bytes) -> bool:
    """Whether there can be an entity at all; never False for a text in which ``find_entities`` finds one."""
    plain = text.decode("utf-8", "replace")
    return _MAY.search(plain) is not None or _GIVEN.search(plain) is not None


def with_surrogates(docs: DataFrame, key: bytes, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text, found)``: texts with their entities replaced, and the entities with places and surrogates. One pass."""
    picked = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = "array<struct<kind:string,start:int,stop:int,value:string,surrogate:string>>"
    fields = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("value", pa.string()), ("surrogate", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = batch.column(1).is_valid().to_pylist()
            texts, lists = [], []
            for ok, raw in zip(known, texts_of(batch), strict=True):
                text, found = raw.decode("utf-8", "replace"), []
                if ok and _quick(raw):
                    new, places = replaced(text, key)
                    found = [{"kind": k, "start": a, "stop": b, "value": text[a:b], "surrogate": surrogate(k, text[a:b], key)} for a, b, k in places]
                    text = new
                texts.append(text if ok else None)
                lists.append(found)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string()), pa.array(lists, fields)], names=["id", "text", "found"])

    return picked.mapInArrow(run, f"id {picked.schema['id'].dataType.simpleString()}, text string, found {kind}")


def entities_of(rows: DataFrame) -> DataFrame:
    """Distinct ``(kind, value, surrogate)`` of ``rows(found)``."""
    return rows.select(F.explode("found").alias("e")).select("e.kind", "e.value", "e.surrogate").distinct()


def entity_table(docs: DataFrame, key: bytes, *, text_col: str = "text") -> DataFrame:
    """Distinct ``(kind, value, surrogate)`` of all documents."""
    return entities_of(with_surrogates(docs, key, id_col=text_col, text_col=text_col))


def collisions(entities: DataFrame) -> DataFrame:
    """Surrogates that several entities of a kind share, and entities that are their own: none, if all is well."""
    shared = entities.groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.max((F.col("value") == F.col("surrogate")).cast("int")).alias("own"))
    return shared.where("n > 1 or own = 1")


def key_of(spark: SparkSession) -> bytes:
    """The secret that surrogates are keyed with: the session's ``tidelog.pii.key``, at least 16 letters. There is no default,
    since whoever knows the key can take surrogates back; without one, a job that does not have to agree with another may draw
    one for itself (``secrets.token_bytes``)."""
    key = spark.conf.get("tidelog.pii.key", None)
    if not key or len(key) < 16:
        raise ValueError("set tidelog.pii.key to a secret of at least 16 letters")
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def pseudonymize(docs: DataFrame, *, key: bytes, id_col: str = "doc_id", text_col: str = "text", check: bool = True) -> DataFrame:
    """``(id, text, n_entities, entities)``, a row per input row; entities as ``kind:start:end`` in the text before, comma-joined.

    Null text stays null and has none; null and repeated ids stay as they are; an empty table gives no rows; other columns are
    not read. ``key`` is a secret of up to 64 bytes: with another key all surrogates are others. Texts are read once, into a
    stored table, and not shuffled; the check reads and shuffles distinct entities only. If two entities of a kind shared a
    surrogate, or one kept its own, all are made anew under a key drawn from the first, up to three times.
    """
    for _ in range(4):
        rows = with_surrogates(docs, key, id_col=id_col, text_col=text_col)
        if check:
            rows = stored(rows, "surrogates")
        if not check or collisions(entities_of(rows)).isEmpty():
            break
        discard(rows)
        key = hashlib.blake2b(b"again", key=key, digest_size=32).digest()
    else:
        raise ValueError("surrogates are not distinct")
    listed = F.array_join(F.transform("found", lambda e: F.concat_ws(":", e["kind"], e["start"].cast("string"), e["stop"].cast("string"))), ",")
    return rows.select(F.col("id").alias(id_col), F.col("text").alias(text_col), F.size("found").cast("long").alias("n_entities"), listed.alias("entities"))
