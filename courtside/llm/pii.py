"""Operator 4, PII: detected entities are replaced by keyed surrogates of the same type, script and format.

Surrogates. An entity's value characters (format characters such as spaces, dots and brackets stay) are a number in mixed
radix, one digit per character, whose radix is its class: digits, Latin, accented Latin, Greek, Cyrillic letters, CJK;
vowels and consonants apart in names; octets in addresses. A keyed permutation maps these numbers within each shape (a
Feistel network; for shapes of few values a keyed cycle through all of them, which no pair of values gives away), so
different entities get different surrogates, equal ones the same wherever and however they are written (coreference across
documents, cases and separators), and nothing has to be stored. Names are mapped word by word: a surname is the same after
a title, after a first name and alone. Card numbers keep whether their check digit holds; first names of a known gender are
permuted among names of that gender, and no other word becomes one of them; other words keep their last letter.

Collision check. A surrogate must not be an entity (of names: a word) of the corpus itself. The distinct entities are joined
with their own surrogates; those that hit one are tried again with a key of the next step, and again while the result is an
entity or a surrogate already given, so the map stays one-to-one; since words move and not whole names, coreference holds. An
entity that finds none in STEPS steps (its shape is used up, or nearly) gets a longer one, keyed and distinct: first names
become compounds of names of the same gender, other names get letters of their script, e-mail addresses and secrets letters,
phone numbers digits; one place more at each further step, until it is free. Addresses, card and social security numbers and
IBANs have no longer form and walk on. The few entities that needed more than one step travel to their documents by a join;
if there are none, that join isn't made.

Detected, each of any length: e-mail addresses, phone numbers, IPv4 and IPv6 addresses, card numbers (13 to 19 digits), US
social security numbers, IBANs, keys and tokens (after a key word, by their issuers' prefixes, or as hex), and names: up to
three capitalised words, of Latin, Greek or Cyrillic letters, after a title or with a listed first name before them. Names
that neither a title nor a listed first name announces are not found: telling them from other capitalised words takes a
model trained on marked names, and there are none to train on here.

Defined cases: null stays null with no entities; texts are read whole; rows with the same id and text are treated alike,
repeated rows too; of overlapping entities the first stays, and names give way; empty tables work; other columns are not
read, not even those named like the new ones.
"""

from __future__ import annotations

import hashlib
import hmac
import ipaddress
import math
import re
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import settle, slices, table

ROUNDS, STEPS, SMALL = 8, 32, 1024

# Alphabets, titles, and first names by gender.
VOWELS, CONSONANTS, LATIN, DIGITS = "aeiou", "bcdfghjklmnpqrstvwxyz", "abcdefghijklmnopqrstuvwxyz", "0123456789"
ACCENTED = "àáâãäåæçèéêëìíîïñòóôõöøùúûüýÿßœ"
GREEK, CYRILLIC = "αβγδεζηθικλμνξοπρστυφχψω", "абвгдежзийклмнопрстуфхцчшщъыьэюя"
CJK = (0x4E00, 0x9FFF)
TITLES = r"Mr|Mrs|Ms|Miss|Dr|Prof|Herr|Frau|Monsieur|Madame|Mademoiselle|Señor|Señora|Señorita|Don|Doña"
FEMALE = "Mary Anna Emma Laura Julia Sarah Maria Elena Carmen Lucia Claire Camille Marie Sophie Chloe Petra Heike Sabine Ursula Monika Alice Susan Linda Karen Nancy".split()
MALE = "John James Robert Michael David Peter Thomas Daniel Carlos Miguel Antonio Javier Pierre Jacques Louis Hugo Hans Klaus Stefan Juergen Dieter Paul Mark Kevin George".split()
_FIRST = {n.lower(): (g, i) for g, names in (("f", FEMALE), ("m", MALE)) for i, n in enumerate(names)}

_CAPITAL = r"[A-ZÀ-ÖØ-ÞĀ-ŽΆ-ΏΑ-ΩЀ-Я][\w'’-]+"
DETECT = re.compile(
    "|".join(
        [
            r"(?P<email>(?<![\w.+-])[\w.+-]++@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,})",
            r"(?P<secret>(?<![^=:\s\"'(,\[])(?:AKIA[0-9A-Z]{16}|(?:sk|pk|rk)[-_][A-Za-z0-9_-]{16,}|gh[opsur]_[A-Za-z0-9]{20,}|github_pat_[A-Za-z0-9_]{20,}|xox[abposr]-[A-Za-z0-9-]{10,}|[0-9a-f]{32,}|[0-9A-F]{32,})(?![\w]))",
            r"(?i:\b(?:api[_-]?key|key|token|secret|passw(?:or)?d)\b\s{0,4}[:=]\s{0,4}[\"']?)(?P<value>[A-Za-z0-9_/+-]{8,}(?:\.[A-Za-z0-9_/+-]+)*)",
            r"(?P<iban>\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b)",
            r"(?P<ip>(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d))",
            r"(?P<ip6>(?<![\w:.])(?=[0-9A-Fa-f:]*:[0-9A-Fa-f:]*:)[0-9A-Fa-f:]{3,}+(?![\w:]))",
            r"(?P<ssn>(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-]))",
            r"(?P<phone>(?<![\w+])(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}(?!\w)|(?<![\w+])\+\d{1,3}(?:[ .-]?\(?\d{2,4}\)?){2,5}(?!\w))",
            r"(?P<card>(?<!\w)\d(?:[ -]?\d){12,18}(?!\w))",
        ]
    )
)
NAMED = re.compile(rf"\b(?:(?:{TITLES})\b\.?\s(?P<name>{_CAPITAL}(?:\s{_CAPITAL}){{0,2}})|(?P<full>(?:{'|'.join([*FEMALE, *MALE])})\s{_CAPITAL}))")
# What a text must hold for a search to be worth while.
_SIGNS = re.compile(r"[@0-9=:]")
_CAPITALISED = re.compile(r"[A-ZÀ-Þ][a-zà-ÿ]+")
_CALLED = {*TITLES.split("|"), *FEMALE, *MALE}
_ISSUED = re.compile(r"AKIA|(?:sk|pk|rk)[-_]|gh[opsur]_|github_pat_|xox[abposr]-")
_NAME_PARTS = re.compile(r"(\s+)")
_KIND = {"value": "secret", "full": "name"}


def folded(text: str) -> str:
    """What words of names are known by, in whatever case: Greek capitals have one sigma."""
    return text.lower().replace("ς", "σ")


def cased(word: str, new: str) -> str:
    """A new word in the case of another: of each letter where there are as many, else all capitals or a capital first."""
    new = f"{new[:-1]}ς" if len(new) > 1 and new[-1] == "σ" else new
    if len(word) > 1 and word.isupper():
        return new.upper()
    if len(word) == len(new):
        return "".join(b.upper() if a.isupper() and len(b.upper()) == 1 else b.lower() if a.islower() else b for a, b in zip(word, new, strict=True))
    return "-".join(x.capitalize() for x in new.split("-")) if word[0].isupper() else new


def luhn_digit(digits: str) -> int:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 else (2 * d - 9 if d > 4 else 2 * d)
    return -total % 10


def normal(kind: str, text: str) -> str | None:
    """What identifies the entity however it is written; None if it isn't one after all."""
    if kind == "ip":
        parts = [int(p) for p in text.split(".")]
        return ".".join(map(str, parts)) if max(parts) < 256 else None
    if kind == "ip6":
        if not re.search(r"\d", text):  # as names in programs are written
            return None
        try:
            return ipaddress.IPv6Address(text).exploded
        except ValueError:
            return None
    if kind in ("phone", "card", "ssn"):
        d = re.sub(r"\D", "", text)
        return d[-10:] if kind == "phone" and len(d) in (10, 11) and d[:-10] in ("", "1") else d
    if kind == "iban":
        return text.replace(" ", "").upper()
    return text.lower() if kind == "email" else text


def _alphabet(c: str, names: bool) -> str:
    if names and c in LATIN:
        return VOWELS if c in VOWELS else CONSONANTS
    return next((a for a in (DIGITS, LATIN, ACCENTED, GREEK, CYRILLIC) if c in a), "")


def _packed(values: list[int], radices: list[int]) -> tuple[int, int]:
    """The mixed-radix number and the count of such numbers; by halves, since secrets can be long."""
    n, size = 0, 1
    if len(values) <= 256:
        for v, r in zip(values, radices, strict=True):
            n, size = n * r + v, size * r
        return n, size
    h = len(values) // 2
    (a, x), (b, y) = _packed(values[:h], radices[:h]), _packed(values[h:], radices[h:])
    return a * y + b, x * y


def _unpacked(n: int, radices: list[int]) -> list[int]:
    if len(radices) > 256:
        h = len(radices) // 2
        a, b = divmod(n, _packed([0] * (len(radices) - h), radices[h:])[1])
        return _unpacked(a, radices[:h]) + _unpacked(b, radices[h:])
    out = [0] * len(radices)
    for i in range(len(radices) - 1, -1, -1):
        n, out[i] = divmod(n, radices[i])
    return out


class Surrogates:
    """The keyed map. permuted() is one step; replaced() writes a surrogate in the original's format."""

    def __init__(self, key: bytes):
        self.key = key
        self.permuted = lru_cache(50_000)(self._permuted)
        self.cycle = lru_cache(2_000)(self._cycle)

    def _cycle(self, shape: str, radices: tuple[int, ...]) -> list[int]:
        """Of each number of a shape with few of them, the next in a keyed cycle through all: none stays as it is."""
        size = math.prod(radices)
        order = sorted(range(size), key=lambda i: hmac.digest(self.key, f"{shape}|cycle|{i}".encode(), "sha256"))
        after = [0] * size
        for a, b in zip(order, [*order[1:], order[0]], strict=True):
            after[a] = b
        return after

    def _mixed(self, shape: str, values: list[int], radices: list[int]) -> list[int]:
        """A permutation of the mixed-radix numbers of this shape."""
        if len(values) == 1 or len(values) <= 10 and math.prod(radices) <= SMALL:
            after = self.cycle(shape, tuple(radices))
            return _unpacked(after[_packed(values, radices)[0]], radices)
        half = len(values) // 2
        (a, x), (b, y) = _packed(values[:half], radices[:half]), _packed(values[half:], radices[half:])
        n, size = [a, b], [x, y]
        for k in range(ROUNDS):
            s = k % 2
            other = f"{n[1 - s]:x}" if size[1 - s] > 1 << 4096 else f"{n[1 - s]}"  # Python writes no longer decimals
            mac = hmac.new(self.key, f"{shape}|{k}|{other}".encode(), hashlib.sha256).digest()
            wide = int.from_bytes(mac + (hashlib.sha512(mac).digest() * (size[s].bit_length() // 512 + 1) if size[s] > 1 << 192 else b""), "big")
            n[s] = (n[s] + wide) % size[s]
        return _unpacked(n[0], radices[:half]) + _unpacked(n[1], radices[half:])

    def _text(self, kind: str, text: str, fixed: frozenset[int] = frozenset()) -> str:
        """Letters and digits permuted within their alphabets; case and all else stay."""
        places, alphabets, values, shape = [], [], [], []
        for i, c in enumerate(text):
            low = c.lower()
            a = _alphabet(low, kind == "name") if len(low) == 1 and i not in fixed else ""
            if a:
                places.append(i), alphabets.append(a), values.append(a.index(low)), shape.append(a[0] + str(len(a)))
            elif CJK[0] <= ord(c) <= CJK[1]:
                places.append(i), alphabets.append(None), values.append(ord(c) - CJK[0]), shape.append("cjk")
            else:
                shape.append(c)
        if not places:
            return text
        upper = "".join("U" if c.isupper() else "l" for c in text) if kind == "secret" else ""
        new = self._mixed(f"{kind}:{''.join(shape)}:{upper}", values, [len(a) if a else CJK[1] - CJK[0] + 1 for a in alphabets])
        out = list(text)
        for i, a, v in zip(places, alphabets, new, strict=True):
            c = a[v] if a else chr(CJK[0] + v)
            out[i] = c.upper() if text[i].isupper() and len(c.upper()) == 1 else c
        return "".join(out)

    def _permuted(self, kind: str, entity: str) -> str:
        if kind == "ip":
            return ".".join(map(str, self._mixed("ip", [int(x) for x in entity.split(".")], [256] * 4)))
        if kind == "ip6":
            return ":".join(f"{g:04x}" for g in self._mixed("ip6", [int(x, 16) for x in entity.split(":")], [1 << 16] * 8))
        if kind == "email":
            local, _, domain = entity.partition("@")
            *labels, top = domain.split(".")
            return self._text("email", local) + "@" + ".".join([*(self._text("label", x) for x in labels), top])
        if kind == "card":
            off = (int(entity[-1]) - luhn_digit(entity[:-1])) % 10
            body = self._text(kind, entity[:-1])
            return body + str((luhn_digit(body) + off) % 10)
        if kind == "phone" and len(entity) == 10:  # stays (or stays not) a number that the plan allows
            allowed = lambda d: d[0] > "1" and d[3] > "1"
            d = self._text(kind, entity)
            while allowed(d) != allowed(entity):
                d = self._text(kind, d)
            return d
        if kind == "iban":
            body = self._text(kind, entity[4:])
            number = lambda s: int("".join(str(int(c, 36)) for c in s))
            if number(entity[4:] + entity[:4]) % 97 == 1:
                return f"{entity[:2]}{98 - number(body + entity[:2] + '00') % 97:02d}{body}"
            return entity[:4] + body
        if kind == "secret" and re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", entity):
            new = self._mixed(f"hex{len(entity)}", [int(c, 16) for c in entity], [16] * len(entity))
            return "".join(f"{v:x}" for v in new) if entity.lower() == entity else "".join(f"{v:X}" for v in new)
        if kind == "name":
            return " ".join(map(self._word, entity.split()))
        issuer = _ISSUED.match(entity) if kind == "secret" else None
        return self._text(kind, entity, frozenset(range(issuer.end())) if issuer else frozenset())

    def _word(self, word: str) -> str:
        """One word of a name, alike wherever it stands."""
        if known := _FIRST.get(word.lower()):
            gender, i = known
            names = FEMALE if gender == "f" else MALE
            new = names[self._mixed(f"first:{gender}", [i], [len(names)])[0]]
            return new.upper() if word.isupper() else new
        fixed = frozenset([len(word) - 1]) if len(word) > 2 else frozenset()
        new = self._text("name", word, fixed)
        while new.lower() in _FIRST and new != word:  # the permutation goes on to the next word that isn't a first name
            new = self._text("name", new, fixed)
        return new

    def longer(self, kind: str, entity: str, more: int) -> str:
        """A surrogate that is longer than the entity by `more` keyed letters, digits or first names. Distinct entities
        have distinct ones: without the places added, which are as many for all, they are those of permuted()."""
        base = self.permuted(kind, entity)
        if kind in ("ip", "ip6", "ssn", "card", "iban") or kind == "phone" and base == entity:
            return base
        seed = int.from_bytes(b"".join(hmac.new(self.key, f"longer|{kind}|{i}|{entity}".encode(), hashlib.sha256).digest() for i in range(more // 32 + 2)), "big")

        def drawn(alphabets: list) -> list:
            nonlocal seed
            out = []
            for a in alphabets:
                seed, i = divmod(seed, len(a))
                out.append(a[i])
            return out

        if base == entity:  # maybe none of its letters has an alphabet here: nothing of it may stay
            new = "".join(drawn([LATIN] * 24))  # distinct as a hash is
            return f"{new}@{new[::-1]}.{entity.rpartition('.')[2]}" if kind == "email" else new.capitalize() if kind == "name" else new
        if kind == "email":
            return "".join(drawn([LATIN] * more)) + base
        if kind == "phone":
            return "".join(drawn(["123456789"] + [DIGITS] * (more - 1))) + base
        if kind == "secret":
            hexed = re.fullmatch(r"[0-9a-f]{32,}|[0-9A-F]{32,}", entity)
            return base + "".join(drawn([("0123456789abcdef" if entity == entity.lower() else "0123456789ABCDEF") if hexed else LATIN if entity != entity.upper() else LATIN.upper()] * more))
        words, own = base.split(" "), entity.split()
        k = next((i for i, w in enumerate(own) if w.lower() not in _FIRST), 0)
        if known := _FIRST.get(own[k].lower()):
            words[k] = "-".join([*drawn([FEMALE if known[0] == "f" else MALE] * more), words[k]])
            return " ".join(words)
        script = next((a for c in words[k].lower() for a in (GREEK, CYRILLIC) if c in a), None)
        letters = "".join(drawn([script or (CONSONANTS, VOWELS)[i % 2] for i in range(more)]))
        words[k] = words[k][:-1] + (letters.upper() if len(words[k]) > 1 and words[k].isupper() else letters) + words[k][-1]
        return " ".join(words)

    @staticmethod
    def replaced(kind: str, text: str, surrogate: str) -> str:
        """The surrogate in the format of text: its separators and, in e-mail addresses, its case."""
        if kind in ("phone", "card", "ssn", "iban"):
            slots = [i for i, c in enumerate(text) if c.isalnum()]
            out = list(text)
            for i, c in zip(reversed(slots), reversed(surrogate)):
                out[i] = c
            if (more := len(surrogate) - len(normal(kind, text) or "")) > 0:  # a longer one: what it has more stands before the number
                slots = slots[-len(surrogate) + more :]
                for i, c in zip(reversed(slots), reversed(surrogate)):
                    out[i] = c
                out = [*text[: slots[0]], surrogate[:more], *out[slots[0] :]]
            return "".join(out)
        if kind == "email" and len(surrogate) == len(text):
            return "".join(s.upper() if c.isupper() and len(s.upper()) == 1 else s for c, s in zip(text, surrogate, strict=True))
        return surrogate


def detected(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, normal form) of each entity, in order. A name within another entity isn't one."""
    found = [*DETECT.finditer(text)] if _SIGNS.search(text) else []
    if not _CALLED.isdisjoint(_CAPITALISED.findall(text)):
        found += NAMED.finditer(text)
    spans = []
    for i, m in enumerate(found):
        kind = m.lastgroup
        entity = normal(_KIND.get(kind, kind), m[kind])
        if entity:
            spans.append((*m.span(kind), i, _KIND.get(kind, kind), entity))
    out, at = [], 0
    for start, stop, _, kind, entity in sorted(_apart(spans)) if found and found[-1].re is NAMED else spans:
        if start >= at:
            out.append((start, stop, kind, entity))
            at = stop
    return out


def _apart(spans: list[tuple]) -> list[tuple]:
    """Without names that overlap an entity of another kind; those don't overlap each other and are in order."""
    others = [(x[0], x[1]) for x in spans if x[3] != "name"]
    starts = [a for a, _ in others]

    def free(start: int, stop: int) -> bool:
        i = bisect_left(starts, stop)
        return i == 0 or others[i - 1][1] <= start

    return [x for x in spans if x[3] != "name" or free(x[0], x[1])]


def _found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in slices(batches, "text", 1 << 20):
        seen = [sorted({(k, w) for _, _, k, e in detected(t or "") for w in (folded(e).split() if k == "name" else [e])}) for t in batch.column("text").to_pylist()]
        rows = [(i, k, e) for i, s in enumerate(seen) for k, e in s]
        at = pa.array([r[0] for r in rows], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column("id").take(at), batch.column("th").take(at), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.string())], names=["id", "th", "kind", "entity"])


def surrogate_steps(entities: DataFrame, key: bytes) -> DataFrame:
    """(kind, entity, surrogate) of the distinct entities whose first surrogate is an entity of the corpus."""

    def step(k: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            s = Surrogates(hmac.new(key, b"step %d" % k, hashlib.sha256).digest() if k else key)
            for b in batches:
                pairs = list(zip(b.column("kind").to_pylist(), b.column("entity").to_pylist(), strict=True))
                new = [s.longer(*x, k - STEPS + 1) if k >= STEPS else s.permuted(*x) for x in pairs]
                new = [n.lower() if x[0] == "name" else n for x, n in zip(pairs, new, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column("kind"), b.column("entity"), pa.array(new, pa.string())], names=["kind", "entity", "surrogate"])

        return run

    schema, by = "kind string, entity string, surrogate string", ["kind", "surrogate"]
    taken = entities.select("kind", F.col("entity").alias("surrogate"))
    first = settle(entities.select("kind", "entity").mapInArrow(step(0), schema))
    left = settle(first.join(taken, by, "left_semi").select("kind", "entity", "surrogate"))
    given = first.join(taken, by, "left_anti").select(by)
    done = left.limit(0)
    for k in count(1):
        if left.isEmpty():
            return done
        tried = settle(left.select("kind", "entity").mapInArrow(step(k), schema))
        clear = settle(tried.join(taken, by, "left_anti").join(given, by, "left_anti").select("kind", "entity", "surrogate"))
        done, given = done.unionByName(clear), given.unionByName(clear.select(by))
        left = settle(tried.join(clear, ["kind", "entity"], "left_anti").select("kind", "entity", "surrogate"))


def replace_entities(docs: DataFrame, key: bytes, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: id, text with surrogates, n_entities, and entities: kind, start, stop in the new text."""
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    found = settle(rows.mapInArrow(_found, f"id {kind}, th long, kind string, entity string"))
    entities = settle(found.select("kind", "entity").distinct())
    moved = settle(surrogate_steps(entities, key))
    special = "special array<struct<kind:string,entity:string,surrogate:string>>"
    if moved.isEmpty():
        rows = rows.withColumn("special", F.lit(None).cast(special.split(" ", 1)[1]))
    else:
        own = found.join(moved, ["kind", "entity"]).groupBy(F.col("id").alias("i"), F.col("th").alias("t")).agg(F.collect_set(F.struct("kind", "entity", "surrogate")).alias("special"))
        rows = rows.join(own, F.col("id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t")), "left").select("id", "th", "text", "special")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s = Surrogates(key)
        for batch in slices(batches, "text", 1 << 20):
            texts, spans = [], []
            for text, own in zip(batch.column("text").to_pylist(), batch.column("special").to_pylist(), strict=True):
                known = {(x["kind"], x["entity"]): x["surrogate"] for x in own or []}
                out, at, size, marks = [], 0, 0, []
                for start, stop, k, entity in detected(text or ""):
                    if k == "name":  # word by word, with the spaces between them
                        new = "".join(cased(w, known.get((k, folded(w))) or s.permuted(k, folded(w))) if w.strip() else w for w in _NAME_PARTS.split(entity))
                    else:
                        new = known.get((k, entity)) or s.permuted(k, entity)
                    new = s.replaced(k, text[start:stop], new)
                    out += [text[at:start], new]
                    size += start - at
                    marks.append({"kind": k, "start": size, "stop": size + len(new)})
                    size, at = size + len(new), stop
                texts.append(None if text is None else "".join([*out, text[at:]]))
                spans.append(marks)
            kinds = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(texts, pa.string()), pa.array([len(x) for x in spans], pa.int64()), pa.array(spans, kinds)], names=["id", "text", "n_entities", "entities"])

    return rows.mapInArrow(run, f"id {kind}, text string, n_entities long, entities array<struct<kind:string,start:int,stop:int>>").withColumnRenamed("id", id_col)


#: The query's key. Another application passes its own secret.
QUERY_KEY = b"courtside query key"


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(table(spark, sf_dir, "documents"), QUERY_KEY)
