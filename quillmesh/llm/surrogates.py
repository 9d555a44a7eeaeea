"""PII: keyed surrogates that keep type, gender, script and format.

Detected: e-mail addresses, phone numbers, payment cards, IBANs, social security numbers, IPv4 and MAC addresses, secrets
(assigned tokens and keys, and well-known key prefixes), and names of persons (after a form of address, or a known given name
before a capitalised word).

A surrogate is a keyed permutation of all strings of the original's shape: each character is a digit of a mixed-radix number
in the alphabet of its class (vowels and consonants of a script, digits, hexadecimal digits), and a Feistel network over
that number, walked until it falls into range, is a bijection. So distinct originals of a type get distinct surrogates over
the whole corpus without a table of them, equal ones get equal surrogates in every document, and case and separators don't
matter to either. Strings of hexadecimal digits are permuted among themselves, and all others among those that are not.

Persons have a gender, from the form of address or from a known given name; a mention whose form tells none has that of the
text's other mentions of the name, if these agree. Known given names are permuted within their list, by gender and script;
other given names (the first of several words) among strings of their shape, by a key of the gender and with the ending
kept that marks it; family names the same way in every gender, but for their gendered ending. Who a person is, is the name
together with the gender.

The key is an argument, never a constant: who knows it can undo the permutation. clashes() checks the corpus: surrogates that
stand for several originals (none, by construction) or that equal an original found elsewhere (chance).

Defined cases: a null text stays null and has no entities; spans don't overlap, the earlier kind in KINDS wins; rows are
treated one by one; strings whose shape has a single member (no letter or digit) stay; other columns are not read.
"""

from __future__ import annotations

import hashlib
import hmac
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checked_broadcast, written

# Given names by script and gender, and forms of address by gender.
GIVEN = {
    ("latin", "f"): "Alice Amelia Anna Charlotte Claire Elena Emily Emma Eva Grace Hannah Helen Isabel Jane Julia Laura Lucia Maria Marie Mary Nina Olivia Paula Sarah Sofia Sophie Susan Teresa Ursula Victoria".split(),
    ("latin", "m"): "Adam Albert Antonio Arthur Bruno Carlos Charles Daniel David Edward Felix Frank George Hans Henri James John Jose Karl Louis Luis Marcel Martin Michael Otto Paul Peter Robert Thomas William".split(),
    ("cyrillic", "f"): "Анна Вера Елена Ирина Мария Наталья Ольга Светлана Софья Татьяна".split(),
    ("cyrillic", "m"): "Алексей Андрей Борис Виктор Дмитрий Иван Михаил Николай Павел Сергей".split(),
}
ADDRESS = {"f": ["Mrs.", "Mrs", "Ms.", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra.", "Signora", "Pani", "Госпожа", "госпожа"], "m": ["Mr.", "Mr", "Herr", "Monsieur", "Señor", "Sr.", "Signor", "Pan", "Господин", "господин"], "": ["Dr.", "Prof."]}
# Forms of address that follow the name, by gender; endings that mark a gender, by script.
AFTER = {"f": ["女士", "小姐"], "m": ["先生"], "": ["博士", "教授"]}
ENDINGS = {"latin": ("ová", "ova", "eva", "ska", "ina", "ella", "ine", "ie", "a", "o"), "cyrillic": ("ова", "ева", "ина", "ская", "ая", "ский", "ий", "ов", "ев", "ин", "а", "я")}

# Frequent Chinese family names; characters that follow a name and are in none; capitalised words that are no name.
HAN_FAMILY = "王李张刘陈杨赵黄周吴徐孙胡朱高林何郭马罗梁宋郑谢韩唐冯于董萧程曹袁邓许傅沈曾彭吕苏卢蒋蔡贾丁魏薛叶阎余潘杜戴夏钟汪田任姜范方石姚谭廖邹熊金陆郝孔白崔康毛邱秦江史顾侯邵孟龙万段雷钱汤尹黎易常武乔贺赖龚文"
HAN_AFTER = "说是在的了和与将会到去来对向也都不很被把让给等就从他她我你您今明昨已要曾还又则并且或先女博教"
NO_NAME = "You Me Him Her It Us Them We They He She The A An This That These Those My Your His Our Their Not And Or But If When".split()

#: A capital of any script that has them, then letters; letters of a script that parts words without case; a Chinese family name and one or two characters.
HAN_NAME = rf"[{HAN_FAMILY}](?:(?![{HAN_AFTER}])\p{{Han}}){{1,2}}"
NAME_WORD = rf"(?:(?!(?:{'|'.join(NO_NAME)})\b)\p{{Lu}}(?:\p{{L}}\p{{M}}*)+(?:[-'’]\p{{Lu}}(?:\p{{L}}\p{{M}}*)+)*|\p{{Lu}}['’]\p{{Lu}}(?:\p{{L}}\p{{M}}*)+|(?:(?!\p{{Han}}|\p{{Hiragana}}|\p{{Katakana}}|\p{{Thai}})\p{{Lo}}\p{{M}}*){{2,12}}|{HAN_NAME})"
FORMS = "|".join(re.escape(x) for xs in ADDRESS.values() for x in sorted(xs, key=len, reverse=True))
GENDER = {x: g for forms in (ADDRESS, AFTER) for g, xs in forms.items() for x in xs}
GIVEN_OF = {n: k for k, ns in GIVEN.items() for n in ns}
KNOWN = "|".join(GIVEN_OF)
FOLLOWING = "|".join(x for xs in AFTER.values() for x in xs)
PERSON = regex.compile(rf"\b(?P<form>{FORMS})(?:(?<=\.)\s*|\s+)(?P<a>{NAME_WORD}(?:\s{NAME_WORD}){{0,2}})|\b(?P<b>(?:{KNOWN})(?:\s{NAME_WORD}){{1,2}})|(?P<c>[{HAN_FAMILY}]\p{{Han}}{{1,2}}?)(?P<after>{FOLLOWING})")
#: A text without any of these has no person.
HINT = re.compile(f"{FORMS}|{KNOWN}|{FOLLOWING}")
WORDS = regex.compile(rf"{NAME_WORD}|\p{{Han}}{{2,4}}")
#: In order of precedence. What is permuted is the whole match, or its group where there is one.
KINDS: dict[str, re.Pattern[str]] = {
    "email": re.compile(r"[^\s@<>()\[\]{},;:\"'|]+@[\w-]+(?:\.[\w-]+)+"),
    "secret": re.compile(
        r"(?i:\b(?:api[_-]?key|token|secret|password|passwd|pwd|access[_-]?key)\b\s*[:=]\s*[\"']?)(?P<x>[A-Za-z0-9+/_.\-=]{8,})"
        r"|\b(?P<y>AKIA[0-9A-Z]{12,}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9_-]{16,}|xox[abprs]-[A-Za-z0-9-]{10,})"
    ),
    "iban": re.compile(r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b"),
    "mac": re.compile(r"\b[0-9A-Fa-f]{2}(?:[:-][0-9A-Fa-f]{2}){5}\b"),
    "ip": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\d]|\.\d)"),
    "ssn": re.compile(r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"),
    "card": re.compile(r"(?<![\d.])(?:\d[ -]?){12,18}\d(?!\d)"),
    # an international prefix, an area code in parentheses or with a leading zero, or groups of 3, 3 and 4: dates, pages and numbers of books have none
    "phone": re.compile(
        r"(?<![\w.+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,5}(?:[ .-]?\d{2,5}){1,4}(?!\w)|(?<![\w.])\(0?\d{2,4}\)[ .-]?\d{2,5}(?:[ .-]?\d{2,5}){0,3}(?!\w)"
        r"|(?<![\w.-])\d{3}([ .-])\d{3}\1\d{4}(?![\w-])|(?<![\w./-])0\d{1,4}[ /-]\d{3,8}(?:[ -]\d{2,5}){0,3}(?![\w/.-])"
    ),
}
DIGITS_ONLY = {"ip", "ssn", "card", "phone", "iban", "mac"}


@lru_cache(maxsize=4096)
def alphabet(c: str, hexadecimal: bool = False) -> str:
    """The characters that may stand for c: of its class, case, script and kind of letter, in code point order."""
    if c.isdigit() and c.isascii():
        return "0123456789"
    if not c.isalpha():
        return c
    if c.isascii():
        letters = ("abcdef" if hexadecimal else "aeiou" if c.lower() in "aeiou" else "bcdfghjklmnpqrstvwxyz") if not hexadecimal or c.lower() in "abcdef" else c.lower()
        return letters.upper() if c.isupper() else letters
    block, kind = ord(c) >> 7, unicodedata.category(c)
    both = [chr(i) for i in range(block << 7, (block + 1) << 7) if unicodedata.category(chr(i)) == kind]
    # those with a partner in the other case only, so that case variants have equal places
    paired = [x for x in both if kind not in ("Lu", "Ll") or (len(x.swapcase()) == 1 and x.swapcase().swapcase() == x and x.swapcase() != x and ord(x.swapcase()) >> 7 == block)]
    return "".join(paired if c in paired else [c])


def permuted(value: int, size: int, key: bytes) -> int:
    """A keyed bijection of 0 .. size - 1: Feistel rounds over the next even number of bits, walked into range."""
    half = max(1, (max(1, (size - 1).bit_length()) + 1) // 2)
    mask = (1 << half) - 1
    while True:
        left, right = value >> half, value & mask
        for r in range(6):
            digest = hashlib.blake2b(right.to_bytes((half + 7) // 8, "big") + bytes([r]), key=key, digest_size=min(64, (half + 7) // 8 + 8)).digest()
            left, right = right, left ^ (int.from_bytes(digest, "big") & mask)
        value = (left << half) | right
        if value < size:
            return value


def reshaped(text: str, key: bytes, kind: str, hexadecimal: bool = False) -> str:
    """The surrogate of a string among all of its shape."""
    sets = [alphabet(c, hexadecimal) for c in text]
    free = [i for i, s in enumerate(sets) if len(s) > 1]
    if not free:
        return text
    value, size = 0, 1
    for i in free:
        value, size = value * len(sets[i]) + sets[i].index(text[i]), size * len(sets[i])
    shape = "".join("0" if text[i].isdigit() else sets[i][0].lower() for i in free)
    k = hmac.new(key, f"{kind}|{shape}".encode(), hashlib.sha256).digest()
    value = permuted(value, size, k)
    out = list(text)
    for i in reversed(free):
        value, at = divmod(value, len(sets[i]))
        out[i] = sets[i][at]
    return "".join(out)


def digits_of(text: str, key: bytes, kind: str, keep: int = 0) -> str:
    """Permutes the digits but the first keep of them, whatever stands between."""
    at = [i for i, c in enumerate(text) if "0" <= c <= "9"][keep:]
    new = reshaped("".join(text[i] for i in at), key, kind)
    out = list(text)
    for i, c in zip(at, new, strict=True):
        out[i] = c
    return "".join(out)


def luhn(digits: str) -> int:
    """The check digit that completes digits."""
    total = sum(sum(divmod(int(d) * (2 - i % 2), 10)) for i, d in enumerate(reversed(digits)))
    return -total % 10


def iban_check(text: str) -> int:
    """The two check digits that an IBAN with this country and account has."""
    plain = text.replace(" ", "")
    return 98 - int("".join(str(int(c, 36)) for c in plain[4:] + plain[:2] + "00")) % 97


def iban(text: str, key: bytes) -> str:
    """The country stays, the account is permuted by country, and the check digits are those of the result, as far off as before."""
    body = reshaped(text[4:], key, f"iban|{text[:2]}")
    right, off = iban_check(text[:4] + body), int(text[2:4]) - iban_check(text)
    new = int(text[2:4]) if not 2 <= int(text[2:4]) <= 98 else 2 + (right - 2 + off) % 97
    return f"{text[:2]}{new:02d}{body}"


def card(text: str, key: bytes) -> str:
    digits = [c for c in text if c.isdigit()]
    if luhn("".join(digits[:-1])) != int(digits[-1]):
        # those with a wrong check digit among themselves: the offset from the right one is kept
        offset = (int(digits[-1]) - luhn("".join(digits[:-1]))) % 10
    else:
        offset = 0
    body = reshaped("".join(digits[:-1]), key, "card")
    new = iter(body + str((luhn(body) + offset) % 10))
    return "".join(next(new) if c.isdigit() else c for c in text)


def ip(text: str, key: bytes) -> str:
    """Addresses with a first part of 1 to 223 stay in that range."""
    parts = [int(x) for x in text.split(".")]
    value = int.from_bytes(bytes(parts), "big")
    inside = 1 <= parts[0] <= 223
    k = hmac.new(key, b"ip", hashlib.sha256).digest()
    low, size = (1 << 24, 223 << 24) if inside else (0, 1 << 32)
    new = value
    while True:
        new = permuted(new - low, size, k) + low
        if inside or not 1 <= new >> 24 <= 223:
            return ".".join(str(b) for b in new.to_bytes(4, "big"))


def phone(text: str, key: bytes) -> str:
    """The last ten digits are permuted; those before, a country code, stay."""
    n = sum(c.isdigit() for c in text)
    return digits_of(text, key, "phone", max(0, n - 10))


def given(name: str, key: bytes) -> str:
    script, gender = GIVEN_OF[name]
    names = GIVEN[(script, gender)]
    k = hmac.new(key, f"given|{script}|{gender}".encode(), hashlib.sha256).digest()
    return names[permuted(names.index(name), len(names), k)]


def renamed(word: str, key: bytes, kind: str) -> str:
    """A word that is no known given name, among those of its shape and ending that are none either."""
    ending = next((e for ends in ENDINGS.values() for e in ends if word.endswith(e) and len(word) > len(e) + 1), "")
    stem = word[: len(word) - len(ending)]
    while True:
        stem = reshaped(stem, key, f"{kind}|{ending}")
        if stem + ending not in GIVEN_OF and not any((stem + ending).endswith(e) and len(e) > len(ending) for ends in ENDINGS.values() for e in ends):
            return stem + ending


def person(text: str, key: bytes, gender: str = "") -> str:
    """Known given names among their list; other given names by gender, family names in one way for all."""
    words = WORDS.findall(text)
    gender = next((GIVEN_OF[w][1] for w in words if w in GIVEN_OF), gender)
    place = iter(range(len(words)))

    def word(w: str) -> str:
        first = next(place) == 0 and len(words) > 1
        return given(w, key) if w in GIVEN_OF else renamed(w, key, f"name|{gender}" if first else "name")

    return WORDS.sub(lambda m: word(m.group()), text)


def email(text: str, key: bytes) -> str:
    local, _, domain = text.rpartition("@")
    name, _, top = domain.rpartition(".")
    return f"{reshaped(local, key, 'local')}@{reshaped(name, key, 'domain')}.{top}"


HEX = re.compile(r"[0-9a-f]+|[0-9A-F]+")


def secret(text: str, key: bytes) -> str:
    """Hexadecimal strings among themselves; others walk on until they meet one that isn't, so that none takes another's place."""
    if HEX.fullmatch(text):
        return reshaped(text, key, "hex", hexadecimal=True)
    while True:
        text = reshaped(text, key, "secret")
        if not HEX.fullmatch(text):
            return text


def surrogate(kind: str, text: str, key: bytes, gender: str = "") -> str:
    if kind == "mac":
        return reshaped(text, key, kind, hexadecimal=True)
    if kind == "person":
        return person(text, key, gender)
    special = {"email": email, "card": card, "iban": iban, "ip": ip, "phone": phone, "secret": secret}.get(kind)
    return special(text, key) if special else reshaped(text, key, kind)


def plausible(kind: str, text: str) -> bool:
    """Cards have their check digit and a first digit of some issuer; IBANs theirs; phone numbers 7 to 15 digits."""
    if kind == "card":
        digits = re.sub(r"\D", "", text)
        return digits[0] in "23456" and len(set(digits)) > 1 and luhn(digits[:-1]) == int(digits[-1])
    if kind == "iban":
        return iban_check(text) == int(text[2:4])
    return kind != "phone" or 7 <= sum(c.isdigit() for c in text) <= 15


def entities(text: str) -> list[tuple[int, int, str, str]]:
    """(start, stop, kind, gender) of what is to be replaced, in order, without overlaps."""
    found: list[tuple[int, int, str, str]] = []
    digits = re.search(r"\d", text) is not None
    taken = bytearray(len(text))

    def add(a: int, b: int, kind: str, gender: str = "") -> None:
        if not any(taken[a:b]):
            taken[a:b] = b"\x01" * (b - a)
            found.append((a, b, kind, gender))

    for kind, pattern in KINDS.items():
        if (kind in DIGITS_ONLY and not digits) or (kind == "email" and "@" not in text):
            continue
        for m in pattern.finditer(text):
            a, b = next((m.span(g) for g, v in m.groupdict().items() if v is not None), m.span())
            if plausible(kind, text[a:b]):
                add(a, b, kind)
    if HINT.search(text):
        for m in PERSON.finditer(text):
            a, b = next(m.span(g) for g in "abc" if m.group(g) is not None)
            add(a, b, "person", GENDER.get(m.group("form") or m.group("after"), ""))
    return with_genders(text, sorted(found))


def with_genders(text: str, found: list[tuple[int, int, str, str]]) -> list[tuple[int, int, str, str]]:
    """Persons without a gender get that of the other mentions of their name, if these have one and agree."""
    known: dict[str, set[str]] = {}
    for a, b, kind, gender in found:
        if kind == "person" and gender:
            known.setdefault(text[a:b], set()).add(gender)
    one = {name: next(iter(g)) for name, g in known.items() if len(g) == 1}
    return [(a, b, kind, gender or (one.get(text[a:b], "") if kind == "person" else "")) for a, b, kind, gender in found]


def replaced(text: str, key: bytes, found: list[tuple[int, int, str, str]] | None = None) -> tuple[str, list[tuple[int, int, str, str]]]:
    """The text with surrogates, and (start, stop, kind, surrogate) of each entity of the old text; found: its entities, if they are known."""
    out, at, spans = [], 0, []
    for a, b, kind, gender in entities(text) if found is None else found:
        new = surrogate(kind, text[a:b], key, gender)
        spans.append((a, b, kind, new))
        out += [text[at:a], new]
        at = b
    return "".join([*out, text[at:]]), spans


def identity(kind: str, text: str, gender: str, key: bytes) -> bytes:
    """A keyed hash of who or what a mention names. Case is ignored, and separators where only digits count; a person's gender counts."""
    plain = re.sub(r"\D", "", text) if kind in ("card", "phone") else text.lower()
    if kind == "person":
        plain += "|" + next((GIVEN_OF[w][1] for w in WORDS.findall(text) if w in GIVEN_OF), gender)
    return hashlib.blake2b(f"{kind}|{plain}".encode(), key=hashlib.sha256(key).digest(), digest_size=12).digest()


SPAN = "struct<start:int,stop:int,kind:string,surrogate:string,original_hash:binary,surrogate_hash:binary>"
SPAN_ARROW = pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("kind", pa.string()), ("surrogate", pa.string()), ("original_hash", pa.binary()), ("surrogate_hash", pa.binary())])


def surrogate_udf(key: bytes):
    if not key:
        raise ValueError("surrogates need a key")

    def run(texts: pa.Array) -> pa.Array:
        new, spans = [], []
        for t in texts:
            old = t.as_py()
            known = entities(old) if t.is_valid else []
            out, found = replaced(old, key, known) if t.is_valid else (None, [])
            new.append(out)
            spans.append([{"start": a, "stop": b, "kind": k, "surrogate": s, "original_hash": identity(k, old[a:b], g, key), "surrogate_hash": identity(k, s, g, key)} for (a, b, k, s), (*_, g) in zip(found, known, strict=True)])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(spans, pa.list_(SPAN_ARROW))], ["text", "spans"])

    return F.arrow_udf(run, f"text string, spans array<{SPAN}>")


def anonymise(docs: DataFrame, key: bytes) -> DataFrame:
    """(doc_id, text, spans): the text with surrogates, and where the originals stood in the old text, as keyed hashes."""
    return docs.select("doc_id", surrogate_udf(key)(F.col("text")).alias("r")).select("doc_id", "r.text", "r.spans")


def clashes(mentions: DataFrame) -> DataFrame:
    """(surrogate_hash, originals, is_original) of surrogates that stand for several originals, or equal an original of the corpus.

    mentions is (original_hash, surrogate_hash), one row for each mention; they are counted once for each pair before they meet.
    """
    pairs = mentions.select("original_hash", "surrogate_hash").distinct()
    values = pairs.select(F.col("surrogate_hash").alias("h"), F.lit(1).alias("n"), F.lit(False).alias("o")).unionAll(pairs.select("original_hash", F.lit(0), F.lit(True)))
    found = values.groupBy("h").agg(F.sum("n").alias("originals"), F.max("o").alias("is_original"))
    return found.where((F.col("originals") > 1) | (F.col("is_original") & (F.col("originals") > 0))).withColumnRenamed("h", "surrogate_hash")


def checked(found: DataFrame, salts: int = 16) -> DataFrame:
    """anonymise()'s rows with n_clashes: how many of a row's surrogates clash with something in the corpus."""
    found = written(found, "surrogates")
    row = [F.col("doc_id").alias("_d"), F.xxhash64("text", "spans").alias("_k")]
    mentions = found.where(F.size("spans") > 0).select(*row, F.explode("spans.surrogate_hash").alias("surrogate_hash"))
    bad = clashes(found.select(F.explode("spans").alias("s")).select("s.original_hash", "s.surrogate_hash"))
    spread = checked_broadcast(bad.select("surrogate_hash")).withColumn("_s", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))  # a common surrogate is met in several tasks
    per_row = mentions.withColumn("_s", F.pmod(F.xxhash64("_k", "_d"), F.lit(salts)).cast("int")).join(spread, ["surrogate_hash", "_s"], "left_semi")
    counts = checked_broadcast(per_row.groupBy("_d", "_k").agg(F.count(F.lit(1)).alias("_n")))
    out = found.withColumn("_k2", F.xxhash64("text", "spans"))
    joined = out.join(counts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_k2") == F.col("_k")), "left")
    return joined.select("doc_id", "text", "spans", F.coalesce("_n", F.lit(0)).alias("n_clashes"))
