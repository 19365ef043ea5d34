"""Surrogates for personal data, in DataFrame functions only.

Entities are found by one pattern. Each has a canonical form (letters in lower case, digits only for numbers), from which a
keyed digest makes the surrogate's canonical form character by character: digits become digits, letters become letters of
the same script, given names become given names of the same gender and script; a secret of symbols only becomes other
symbols. The surrogate is then written in the format of the occurrence: its separators, its case, its untouched parts
(country codes, top-level domains, card brands). Card and IBAN check digits are made right where they were right. One
canonical form has one surrogate everywhere, which keeps coreference; surrogates that meet each other or an original get
another digest until none do, which keeps distinctness. Every entity can be replaced: from the ``CALM``-th further digest
on a surrogate grows by a character a time (digits for numbers), so that short forms of which all are taken end as well.
Only the entities that had to be changed, rarely any, are joined back; all else stays in its row.

The caller brings the key; without it surrogates can't be traced back. Tables in the shared folder hold keyed digests, and
texts of entities only under AES with that key.

Defined results: null text stays null; text without entities is returned as it is; rows with a null id are treated alike;
repeated rows get the same surrogates; where several kinds of entity start at one place, the first kind of ``KINDS`` wins;
texts of any length are read whole, each in its row, and no pattern is tried further than a bounded number of characters
from its start, a secret's value alone excepted (above ``LONG`` characters it is replaced by repeated digests); letters of
scripts without an alphabet here become Latin; an empty table gives an empty result; only id and text are read and text is
replaced, other columns pass through, whatever their names.
"""

from __future__ import annotations

import hashlib
import secrets
import unicodedata

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Scratch, fresh, let

# Given names by script and gender, and the titles that tell gender.
NAMES = {
    "latin_f": ["Anna", "Clara", "Elena", "Emma", "Jane", "Julia", "Laura", "Lucia", "Maria", "Marta", "Mary", "Nora", "Paula", "Sara", "Susan"],
    "latin_m": ["Adam", "Bruno", "Carlos", "David", "Felix", "Hugo", "James", "John", "Jonas", "Karl", "Lukas", "Mark", "Oscar", "Peter", "Robert"],
    "cyrillic_f": ["Анна", "Вера", "Дарья", "Елена", "Ирина", "Мария", "Нина", "Ольга"],
    "cyrillic_m": ["Антон", "Борис", "Иван", "Игорь", "Максим", "Олег", "Павел", "Сергей"],
}
TITLES = {"m": ["Mr", "Herr", "Sr", "Señor", "Monsieur", "Господин"], "f": ["Mrs", "Ms", "Miss", "Frau", "Sra", "Señora", "Mme", "Madame", "Госпожа"], "n": ["Dr", "Prof"]}
_EDGE, _END = r"(?<![\p{L}\p{N}])", r"(?![\p{L}\p{N}])"
_NAME = r"\p{Lu}[\p{L}'\-]{1,60}"
_GIVEN = "|".join(n for v in NAMES.values() for n in v)
_TITLE = "|".join(t for v in TITLES.values() for t in v)
#: In order of precedence where several start at one place.
KINDS = {
    "email": r"[\p{L}\p{N}._%+\-]{1,128}+@(?:[\p{L}\p{N}\-]{1,63}\.){1,126}\p{L}{2,63}",
    "name": rf"(?=\p{{Lu}})(?:(?:{_TITLE})\.?\x20(?:{_NAME})(?:\x20{_NAME})?|(?:{_GIVEN})\x20{_NAME})",
    "secret": r"(?=[pPsStTaA])(?i:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\"']?[^\s\"']{6,}|AKIA[0-9A-Z]{16}|[0-9a-f]{32,64}",
    "iban": r"[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?",
    "ssn": r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
    "ip": r"(?=[0-9]{1,3}\.)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![.]?[0-9])",
    "phone": r"\+[0-9]{1,3}[\x20.\-]?(?:\([0-9]{1,4}\)[\x20.\-]?)?[0-9]{2,4}(?:[\x20.\-]?[0-9]{2,4}){1,4}|\([0-9]{3}\)\x20?[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}",
    "card": r"[0-9](?:[\x20\-]?[0-9]){12,18}",
}
PATTERN = "(?:" + _EDGE + "(?:" + "|".join(f"(?:{KINDS[k]})" for k in KINDS if k != "phone") + ")" + _END + ")|(?:" + r"(?<![\p{L}\p{N}+])" + f"(?:{KINDS['phone']}){_END})"
#: A text without a match of this has no entity; every alternative is gated by one character.
HINT = rf"[0-9@=:]|(?=\p{{Lu}})(?:{_TITLE}|{_GIVEN})[.\x20]"
# Scripts, the range of their blocks and the range of their plain letters.
SCRIPTS = {
    "Latin": (0x00, 0x24F, 0x61, 0x7A), "Greek": (0x370, 0x3FF, 0x3B1, 0x3C9), "Cyrillic": (0x400, 0x52F, 0x430, 0x44F), "Armenian": (0x530, 0x58F, 0x561, 0x586), "Hebrew": (0x590, 0x5FF, 0x5D0, 0x5EA),
    "Arabic": (0x600, 0x6FF, 0x627, 0x64A), "Devanagari": (0x900, 0x97F, 0x905, 0x939), "Bengali": (0x980, 0x9FF, 0x985, 0x9B9), "Gurmukhi": (0xA00, 0xA7F, 0xA05, 0xA39), "Gujarati": (0xA80, 0xAFF, 0xA85, 0xAB9),
    "Tamil": (0xB80, 0xBFF, 0xB85, 0xBB9), "Telugu": (0xC00, 0xC7F, 0xC05, 0xC39), "Kannada": (0xC80, 0xCFF, 0xC85, 0xCB9), "Malayalam": (0xD00, 0xD7F, 0xD05, 0xD39), "Sinhala": (0xD80, 0xDFF, 0xD85, 0xDC6),
    "Thai": (0xE00, 0xE7F, 0xE01, 0xE2E), "Lao": (0xE80, 0xEFF, 0xE81, 0xEAE), "Myanmar": (0x1000, 0x109F, 0x1000, 0x1020), "Georgian": (0x10A0, 0x10FF, 0x10D0, 0x10F0), "Ethiopic": (0x1200, 0x137F, 0x1200, 0x1248),
    "Khmer": (0x1780, 0x17FF, 0x1780, 0x17A2), "Hiragana": (0x3040, 0x309F, 0x3042, 0x3093), "Katakana": (0x30A0, 0x30FF, 0x30A2, 0x30F3), "Han": (0x3400, 0x9FFF, 0x4E00, 0x4F00), "Hangul": (0xAC00, 0xD7AF, 0xAC00, 0xAD00),
}
SYMBOLS = "!#$%&*+-=?@^_~"
CALM, LONG = 4, 256


def _alphabet(first: int, last: int) -> str:
    """The letters of a range that are lower case or have no case."""
    return "".join(c for c in map(chr, range(first, last + 1)) if unicodedata.category(c) in ("Ll", "Lo") and c.upper().lower() == c)


ALPHABETS = {name: _alphabet(a, b) for name, (_, _, a, b) in SCRIPTS.items()}
#: For every 16 code points the number of their script, as a letter; Latin where there is none.
_BLOCKS = "".join(chr(65 + next((k for k, (a, b, _, _) in enumerate(SCRIPTS.values()) if a <= c <= b), 0)) for c in range(0, 0x10000, 16))


def kind_of(v: Column) -> Column:
    out = F.lit("card")
    for k in reversed([*KINDS]):
        if k != "card":
            out = F.when(v.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(out)
    return out


def canonical(kind: Column, v: Column) -> Column:
    """What makes two occurrences the same entity. Names: the name without its title."""
    name = F.lower(F.regexp_replace(v, rf"^(?:{_TITLE})\.?\x20", ""))
    secret = F.regexp_replace(v, r"^(?i:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\"']?", "")
    digits, alnum = F.regexp_replace(v, "[^0-9]", ""), F.lower(F.regexp_replace(v, r"[^\p{L}\p{N}]", ""))
    return F.when(kind.isin("phone", "card", "ssn"), digits).when(kind == "iban", alnum).when(kind == "name", name).when(kind == "secret", secret).when(kind == "ip", v).otherwise(F.lower(v))


def _bytes(seed: Column) -> Column:
    """64 keyed byte values of a seed."""
    d = F.sha2(seed, 512)
    return F.transform(F.sequence(F.lit(1), F.lit(127), F.lit(2)), lambda i: F.conv(F.substring(d, i, F.lit(2)), 16, 10).cast("int"))


def _bind(x: Column, f) -> Column:
    """f of x, x being worked out once."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def _swap(c: Column, b: Column, hexa: Column, symbols: Column) -> Column:
    """Another character of the same type: digit, letter of the script in the same case, and a symbol where symbols say so."""
    low, digit, latin = F.lower(c), "0123456789", ALPHABETS["Latin"]
    number = F.ascii(F.substring(F.lit(_BLOCKS), F.shiftright(F.ascii(low), 4) + 1, F.lit(1))) - 65
    script = F.coalesce(F.get(F.split(F.lit(" ".join(ALPHABETS.values())), " "), number), F.lit(latin))
    other = F.when(low.rlike(r"\p{L}"), script).when(low.rlike(r"\p{N}"), digit)
    given = F.when(c.between("0", "9"), digit).when(low.between("a", "f") & hexa, "abcdef").when(low.between("a", "z"), latin).when(F.ascii(low) > 127, other)
    return _bind(F.coalesce(given, F.when(symbols, SYMBOLS), low), lambda s: _bind(F.substring(s, b % F.length(s) + 1, F.lit(1)), lambda x: F.when(c == F.lower(c), x).otherwise(F.upper(x))))


def _fixed(kind: Column, c: Column) -> Column:
    """How many leading characters of a canonical form stay: country codes, card brands, a secret's own prefix."""
    return F.when(kind == "iban", 4).when(kind == "card", 1).when((kind == "phone") & (F.length(c) > 10), F.length(c) - 10).when((kind == "secret") & c.startswith("AKIA"), 4).otherwise(0)


def _digit_sum(chars: Column) -> Column:
    """Luhn sum of digits, the last one being the check digit."""
    return F.aggregate(F.transform(F.reverse(chars), lambda x, i: F.when(i % 2 == 0, x.cast("int")).otherwise(F.floor(x.cast("int") * 2 / 10).cast("int") + x.cast("int") * 2 % 10)), F.lit(0), lambda a, x: a + x)


def _mod97(s: Column) -> Column:
    """Remainder by 97 of an IBAN's digits, letters counting from 10."""
    return F.aggregate(F.split(s, ""), F.lit(0), lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 87) % 97))


def surrogate(kind: Column, form: Column, tries: Column, key: str) -> Column:
    """The surrogate's canonical form."""
    seed = lambda c: F.concat_ws("|", F.lit(key), kind, c, tries.cast("string"))
    return _bind(form, lambda c: _bind(F.struct(_bytes(seed(c)).alias("d"), F.sha2(seed(c), 512).alias("h")), lambda x: _surrogate(kind, c, tries, key, x.d, x.h)))


def _surrogate(kind: Column, c: Column, tries: Column, key: str, digest: Column, text_digest: Column) -> Column:
    word = lambda w: F.sha2(F.concat_ws("|", F.lit(key), F.lit("word"), w), 256)
    byte = lambda i: F.get(digest, (i % 64).cast("int")) + F.floor(i / 64).cast("int")
    no = F.lit(False)
    # What stays: leading and trailing characters. Whether letters are hexadecimal digits, and whether there are only symbols.
    plan = F.struct(_fixed(kind, c).alias("keep"), (F.length(c) - F.when(kind == "email", F.instr(F.reverse(c), ".")).otherwise(0)).alias("upto"), ((kind == "secret") & c.rlike("^[0-9a-fA-F]+$")).alias("hexa"), ((kind == "secret") & ~c.rlike(r"[\p{L}\p{N}]")).alias("bare"))
    letters = _bind(plan, lambda p: F.array_join(F.transform(F.split(c, ""), lambda x, i: F.when((i < p.keep) | (i >= p.upto), x).otherwise(_swap(x, byte(i), p.hexa, p.bare))), ""))
    mapped = F.when((kind == "secret") & (F.length(c) > LONG), F.substring(F.repeat(text_digest, F.ceil(F.length(c) / 128).cast("int")), F.lit(1), F.length(c))).otherwise(letters)
    # IPv4: four octets, the first and last from 1 to 254.
    ip = F.array_join(F.transform(F.slice(digest, 1, 4), lambda b, i: F.when(i % 3 == 0, b % 254 + 1).otherwise(b).cast("string")), ".")
    head = lambda m: F.substring(m, F.lit(1), F.length(c) - 1)
    luhn = lambda m: F.when(_digit_sum(F.split(c, "")) % 10 == 0, F.concat(head(m), ((10 - _digit_sum(F.split(F.concat(head(m), F.lit("0")), "")) % 10) % 10).cast("string"))).otherwise(m)
    turned = lambda s: F.concat(F.substring(s, F.lit(5), F.length(s)), F.substring(s, 1, 2))
    valid = _mod97(F.concat(turned(c), F.substring(c, 3, 2))) == 1
    iban = lambda m: F.when(valid, F.concat(F.substring(m, 1, 2), F.lpad((98 - _mod97(F.concat(turned(m), F.lit("00")))).cast("string"), 2, "0"), F.substring(m, F.lit(5), F.length(c)))).otherwise(m)
    person = F.array_join(F.transform(F.split(c, " "), lambda w: _bind(word(F.concat_ws("|", w, tries.cast("string"))), lambda d: _person(w, d))), " ")
    # Each large part is named once: the driver analyses and keeps as many copies of it as the expression has.
    body = _bind(F.when(kind.isin("ip", "name"), F.lit(None)).otherwise(mapped), lambda m: F.when(kind == "ip", ip).when(kind == "card", luhn(m)).when(kind == "iban", iban(m)).when(kind == "name", person).otherwise(m))
    # What a surrogate grows by when many are taken.
    more, last = tries - CALM + 1, F.substring(c, F.length(c), F.lit(1))
    seed = F.when(kind.isin("phone", "card", "ssn", "iban", "ip"), "0").when((kind == "name") & last.rlike(r"\p{L}"), last).otherwise("a")
    grown = F.array_join(F.transform(F.sequence(F.lit(1), more), lambda j: _swap(seed, byte(63 - j % 64 + j), no, no)), "")
    parts = F.struct(body.alias("b"), F.when(more > 0, grown).alias("g"))
    return _bind(parts, lambda x: F.when(more <= 0, x.b).when(kind == "email", F.concat(x.g, x.b)).otherwise(F.concat(x.b, F.when(kind == "ip", ":").otherwise(""), x.g)))


def _person(w: Column, digest: Column) -> Column:
    """A part of a name: given names by gender and script from the lists, others letter by letter in their script."""
    at = F.conv(F.substring(digest, 1, 6), 16, 10).cast("int")
    b = lambda i: F.conv(F.substring(digest, (i % 29) * 2 + 1, F.lit(2)), 16, 10).cast("int")
    out = F.array_join(F.transform(F.split(w, ""), lambda x, i: _swap(x, b(i), F.lit(False), F.lit(False))), "")
    for names in NAMES.values():
        low = [n.lower() for n in names]
        out = F.when(w.isin(low), F.get(F.array(*map(F.lit, low)), at % len(low))).otherwise(out)
    return out


def render(kind: Column, v: Column, s: Column) -> Column:
    """A surrogate's canonical form in the format of an occurrence."""
    head = F.when(kind == "name", F.regexp_extract(v, rf"^(?:(?:{_TITLE})\.?\x20)?", 0)).when(kind == "secret", F.regexp_extract(v, r"^(?:(?i:password|passwd|secret|token|api_?key)\x20?[=:]\x20?[\"']?)?", 0)).otherwise("")
    return _bind(F.struct(head.alias("h"), F.substring(v, F.length(head) + 1, F.length(v)).alias("b")), lambda x: F.concat(x.h, _render(kind, x.b, s)))


def _render(kind: Column, body: Column, s: Column) -> Column:
    # Numbers and IBANs: the k-th digit or letter of the occurrence takes the k-th character of the surrogate.
    step = lambda a, c: F.when(c.rlike(r"[0-9]") | ((kind == "iban") & c.rlike(r"\p{L}")), F.struct((a.k + 1).alias("k"), F.concat(a.o, _like(c, F.substring(s, a.k + 1, F.lit(1)))).alias("o"))).otherwise(F.struct(a.k.alias("k"), F.concat(a.o, c).alias("o")))
    walk = F.aggregate(F.split(body, ""), F.struct(F.lit(0).alias("k"), F.lit("").alias("o")), step, lambda a: F.concat(a.o, F.substring(s, a.k + 1, F.length(s))))
    titled = F.when(body == F.upper(body), F.upper(s)).otherwise(F.initcap(s))
    mixed = _bind(F.split(body, ""), lambda chars: F.array_join(F.transform(F.split(s, ""), lambda x, i: _like(F.coalesce(F.get(chars, i), F.lit("a")), x)), ""))
    cased = F.when(body == F.lower(body), s).when(body == F.upper(body), F.upper(s)).otherwise(mixed)
    return F.when(kind.isin("phone", "card", "ssn", "iban"), walk).when(kind == "name", titled).when(kind.isin("secret", "ip"), s).otherwise(cased)


def _like(c: Column, x: Column) -> Column:
    return F.when((c != F.lower(c)) & (c == F.upper(c)), F.upper(x)).otherwise(x)


def entities(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """i (id), m (hash of the text), pos (number of the occurrence), v (as written), kind, c (canonical)."""
    t = docs[text]
    df = docs.where(t.rlike(HINT)).select(docs[key].alias("i"), F.xxhash64(t).alias("m"), t.alias("t"))
    df = df.select("i", "m", F.posexplode(F.regexp_extract_all("t", F.lit(PATTERN), F.lit(0))).alias("pos", "v"))
    df = let(df, "e", kind=kind_of(F.col("v")))
    return df.select("i", "m", "pos", "v", F.col("e__kind").alias("kind"), canonical(F.col("e__kind"), F.col("v")).alias("c"))


def session_secret(spark: SparkSession) -> str:
    """The key of a session: its setting, or one drawn at random and kept for the session alone."""
    name = "spark.trackwise.surrogates.secret"
    if not spark.conf.get(name, None):
        spark.conf.set(name, secrets.token_hex(32))
    return spark.conf.get(name)


def _digest(kind: Column, form: Column, secret: str) -> Column:
    """What stands for a canonical form, of an original or of a surrogate, in tables."""
    return F.substring(F.sha2(F.concat_ws("|", F.lit(secret), F.lit("digest"), kind, form), 256), 1, 32)


def _vault(secret: str) -> Column:
    return F.unhex(F.lit(hashlib.sha256(f"vault|{secret}".encode()).hexdigest()))


def changed_keys(found: DataFrame, secret: str, scratch: Scratch) -> DataFrame:
    """kind, ck, tries (over 0): the entities whose first surrogate would meet another or an original. found has kind, ck
    (digest of the canonical form) and e (the form, encrypted)."""
    ents = scratch.put(found.groupBy("kind", "ck").agg(F.first("e").alias("e")), "entities")
    # Few bytes but much work each: spread by hash whatever the size, and made once.
    parts = int(found.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    taken, pending, changed, tries = ents.select("kind", F.col("ck").alias("sk")), ents, None, 0
    while True:
        made = let(pending.repartition(parts, "ck"), "s", c=F.aes_decrypt("e", _vault(secret)).cast("string"))
        made = let(made, "s", s=surrogate(F.col("kind"), F.col("s__c"), F.lit(tries), secret))
        made = scratch.put(made.select("kind", "ck", "e", _digest(F.col("kind"), F.col("s__s"), secret).alias("sk")), "made")
        first = made.groupBy("kind", "sk").agg(F.min("ck").alias("first"))
        met = taken.join(made.select("kind", "sk"), ["kind", "sk"], "left_semi").distinct().withColumn("met", F.lit(True))
        own = made.join(first, ["kind", "sk"]).join(met, ["kind", "sk"], "left")
        own = scratch.put(own.withColumn("again", F.coalesce("met", F.lit(False)) | (F.col("ck") != F.col("first"))).select("kind", "ck", "sk", "e", "again"), "tried")
        fine, pending = own.where(~F.col("again")), own.where("again").select("kind", "ck", "e")
        if tries:
            new = fine.select("kind", "ck", F.lit(tries).alias("tries"))
            changed = new if changed is None else changed.unionByName(new)
        if not pending.limit(1).count():
            return ents.select("kind", "ck", F.lit(0).alias("tries")).limit(0) if changed is None else changed
        taken, tries = taken.unionByName(fine.select("kind", "sk")), tries + 1


def replace_pii(docs: DataFrame, secret: str, key: str = "doc_id", text: str = "text", count: str | None = None) -> DataFrame:
    """docs with surrogates in text, made with the caller's secret; count names an optional column for the number of
    entities."""
    if not secret:
        raise ValueError("surrogates need a secret")
    scratch = Scratch(docs.sparkSession)
    found = entities(docs, key, text).select("i", "m", "pos", "kind", _digest(F.col("kind"), F.col("c"), secret).alias("ck"), F.aes_encrypt("c", _vault(secret)).alias("e"))
    found = scratch.put(found, "found")
    more = changed_keys(found, secret, scratch)
    name = fresh(docs, "__pii")
    cols = docs.columns
    df = docs
    tries = F.lit(None).cast("map<int,int>")
    if more.limit(1).count():
        fix = found.join(more, ["kind", "ck"]).groupBy("i", "m", "pos").agg(F.max("tries").alias("tries")).groupBy("i", "m").agg(F.map_from_entries(F.collect_list(F.struct("pos", "tries"))).alias("tries"))
        fix = scratch.put(fix.toDF("__i", "__m", f"{name}_n"), "fix")
        df = docs.join(fix, docs[key].eqNullSafe(fix["__i"]) & (F.xxhash64(docs[text]) == fix["__m"]), "left").select(*[docs[c] for c in cols], fix[f"{name}_n"])
        tries = F.col(f"{name}_n")
    scratch.drop(*[n for n in list(scratch.paths) if n != "fix"])
    hit = F.when(F.col(text).rlike(HINT), F.col(text))
    df = let(df, name, hit=hit, tries=tries)
    df = let(df, name, v=F.regexp_extract_all(f"{name}__hit", F.lit(PATTERN), F.lit(0)))
    # Only texts that have entities are taken apart.
    df = let(df, name, gaps=F.when(F.size(f"{name}__v") > 0, F.split(f"{name}__hit", PATTERN, -1)))
    v, gaps = F.col(f"{name}__v"), F.col(f"{name}__gaps")
    of = lambda x, i: F.struct(x.alias("v"), kind_of(x).alias("k"), F.coalesce(F.try_element_at(F.col(f"{name}__tries"), i), F.lit(0)).alias("n"))
    df = let(df, name, e=F.transform(v, of))
    df = let(df, name, s=F.transform(f"{name}__e", lambda x: F.struct(x.v.alias("v"), x.k.alias("k"), surrogate(x.k, canonical(x.k, x.v), x.n, secret).alias("s"))))
    new = F.transform(f"{name}__s", lambda x: render(x.k, x.v, x.s))
    df = let(df, name, text=F.array_join(F.zip_with(gaps, new, lambda g, x: F.concat(g, F.coalesce(x, F.lit("")))), ""))
    out = F.when(F.size(v) > 0, F.col(f"{name}__text")).otherwise(F.col(text))
    extra = [F.greatest(F.coalesce(F.size(v), F.lit(0)), F.lit(0)).alias(count)] if count else []
    return df.select(*[out.alias(c) if c == text else F.col(c) for c in cols], *extra)
