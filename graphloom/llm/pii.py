"""Personal data replaced by surrogates, in DataFrame expressions only.

Detected entities get keyed replacements of their own type and format. One key
and one entity always give one surrogate, in every document, so mentions of
one person or account still belong together. Every surrogate comes from a
permutation of the entities of its format, a keyed four-round Feistel network,
so different entities get different surrogates by construction:

* the digits of phones, cards and social security numbers are permuted and put
  back between the separators they stood in; a card keeps its first four
  digits and gets the check digit of its new number, so it stays a valid one;
* IPv4 addresses are permuted as numbers, IPv6 addresses by their digits;
* secrets are permuted character by character: digits stay digits, letters
  letters of their case and script, hexadecimal strings hexadecimal; a secret
  of punctuation alone gets other punctuation;
* addresses of mail keep the look of their local part and domain and their
  top-level domain, behind ``.example``; equal domains stay equal;
* names after a title are replaced word by word, vowels by vowels and
  consonants by consonants of their script, with an ending for the title's
  gender. Their words are replaced alike wherever else the text has them;
  without a gendered title they take the gender of the first such mention in
  the text, or else a man's ending.

A keyword before a secret, quotes and the scheme of an address stay. Numbers
of 13 to 19 digits are cards only with an issuer's first digits and a right
check digit; others stay as they are.

``collisions`` looks over the whole corpus for surrogates that two entities
share or that are themselves an entity of the corpus; ``choose_round`` takes
the turn of the key that has none, or the one with the fewest: where a format
has few values and the corpus most of them, some are met whatever the key.

Text is split at the entities and joined with their surrogates; nothing else
of it changes. Null texts stay null and have no entity, nor have empty ones;
an empty table gives an empty table; very long texts are searched whole;
repeated rows are replaced alike.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

TITLE = "Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame|Господин|Госпожа"
_LETTER = r"[\p{L}\p{M}]"
_WORD = rf"(?!(?:{TITLE})(?!{_LETTER}))\p{{Lu}}(?:{_LETTER}++(?:['’\-]\p{{Lu}}{_LETTER}++)*|(?:['’\-]\p{{Lu}}{_LETTER}++)+|\.(?= \p{{Lu}}))"
_PARTICLES = r"(?:(?:von|van|de|der|den|del|della|di|da|du|la|le|zu|ter|ten|bin|al|el) ){0,3}"
#: Words with internal capitals, apostrophes and hyphens, initials, particles.
NAME = rf"{_PARTICLES}{_WORD}(?: {_PARTICLES}{_WORD}){{0,7}}"
_KEYWORD = r"(?i:password|passwd|secret|api_key|apikey|token|pwd)[\"']?\s*[=:]\s*"
_EMAIL = r"[A-Za-z0-9._%+\-]++@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){0,126}\.[A-Za-z]{2,63}(?![A-Za-z0-9])"
_SCHEME = r"[a-z][a-z0-9+.\-]{0,30}://"
#: A keyword and a verb; the secret after them has a digit.
_TOLD = r"(?i:password|passwd|passphrase|secret|api_key|apikey|token|pwd)\s+(?:is|was)\s+"
# Keys of services by their prefixes, signed tokens in three parts, bearer tokens, a
# private key with its boundary lines, account numbers (two letters, two digits, groups
# of four), device addresses, and runs of 40 characters of base64 with a digit.
_KEYS = "|".join([
    r"gh[oprsu]_[0-9A-Za-z]{20,}+", r"github_pat_[0-9A-Za-z_]{22,}+", r"glpat-[0-9A-Za-z_\-]{20,}+", r"xox[a-z]-[0-9A-Za-z\-]{10,}+", r"[rs]k_(?:live|test)_[0-9A-Za-z]{16,}+", r"sk-[0-9A-Za-z_\-]{20,}+",
    r"AIza[0-9A-Za-z_\-]{35}", r"ASIA[0-9A-Z]{16}", r"npm_[0-9A-Za-z]{36}", r"hf_[0-9A-Za-z]{30,}+", r"eyJ[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+\.[0-9A-Za-z_\-]{8,}+",
    r"[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?", r"(?:[0-9A-Fa-f]{2}[:\-]){5}[0-9A-Fa-f]{2}", r"(?=[0-9A-Za-z+/]{0,39}[0-9])[0-9A-Za-z+/]{40,}+={0,2}",
])
_BEARER, _BEGIN = r"[Bb]earer ", r"-----BEGIN (?:[0-9A-Z]+ ){0,4}PRIVATE KEY-----"
_OTHER_SECRETS = rf"(?<![0-9A-Za-z]){_TOLD}(?=\S{{0,60}}[0-9])[^\s\"']{{6,}}+|(?<![0-9A-Za-z]){_BEARER}[0-9A-Za-z._~+/\-]{{16,}}+=*|{_BEGIN}[^\-]++(?:-[^\-]++)*+(?=-----END)|(?<![0-9A-Za-z+/=_\-])(?:{_KEYS})(?![0-9A-Za-z])"
#: What a text without digit, at-sign, colon, equals sign and title can have of them.
_KEY_STARTS = "gh[oprsu]_|github_pat_|glpat-|xox|[rs]k[_-]|AIza|ASIA|npm_|hf_|eyJ|[Bb]earer |-----BEGIN"

# What is detected, in order of precedence; at one place the first that fits wins.
PATTERNS: dict[str, str] = {
    "email": rf"(?<![A-Za-z0-9._%+\-]){_EMAIL}",
    "secret": rf"(?<![A-Za-z0-9]){_KEYWORD}(?:\"[^\"]{{4,}}(?=\")|'[^']{{4,}}(?=')|(?!{_EMAIL})[^\s\"']{{6,}}+)|(?<![A-Za-z0-9]){_SCHEME}[^\s/@:]+:[^\s/@]+@\S+|(?<![A-Za-z0-9])AKIA[0-9A-Z]{{16}}(?![A-Za-z0-9])|(?<![A-Za-z0-9])(?:[0-9a-f]{{32,64}}+|[0-9A-F]{{32,64}}+)(?![A-Za-z0-9])|{_OTHER_SECRETS}",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[\s.\-]?\(?[0-9]{2,4}\)?[\s.\-]?[0-9]{3,4}[\s.\-]?[0-9]{3,4}(?![0-9])|(?<![0-9.\-])\(?[0-9]{3}\)?[ .\-][0-9]{3}[.\-][0-9]{4}(?![0-9])|(?<![0-9.\-])[2-9][0-9]{2} [2-9][0-9]{2} [0-9]{4}(?![0-9])",
    "card": r"(?<![0-9])[0-9]{4}(?:[ \-][0-9]{4}){3}(?![0-9])|(?<![0-9A-Za-z])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9A-Za-z])",
    "ssn": r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
    "ip": r"(?<![0-9.])(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])(?![0-9]|\.[0-9])|(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f:]*[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![0-9A-Za-z:])|(?<![0-9A-Za-z:.])::[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}(?![0-9A-Za-z:])",
    "name": rf"(?<=[rsfuaeна.] )(?<=\b(?:{TITLE})\.? ){NAME}",
}
FEMALE = r"(?:Mrs|Ms|Frau|Señora|Madame|Госпожа)\.? (?:(?:Dr|Prof)\.? )*$"
MALE = r"(?:Mr|Herr|Señor|Monsieur|Господин)\.? (?:(?:Dr|Prof)\.? )*$"
ENTITY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What of a match stays before the entity.
HEAD = rf"^(?:{_KEYWORD}[\"']?|{_SCHEME}|{_TOLD}|{_BEARER}|{_BEGIN})"
#: First digits of cards by issuer.
ISSUER = "^(?:4|5[1-5]|2[2-7]|3[47]|3[0689]|35|6[0-9])"
#: Characters that stand for one another. All of one string are of one kind.
ALPHABETS = ["0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "абвгдежзийклмнопрстуфхцчшщъыьэюя", "АБВГДЕЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯ"]
SPOKEN = ["aeiouy", "AEIOUY", "bcdfghjklmnpqrstvwxz", "BCDFGHJKLMNPQRSTVWXZ", "аеиоуыэюя", "АЕИОУЫЭЮЯ", "бвгджзклмнпрстфхцчш", "БВГДЖЗКЛМНПРСТФХЦЧШ", "àáâãäåèéêëìíîïòóôõöùúûüý", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜÝ"]
HEXADECIMAL = ["0123456789abcdef"]
PUNCTUATION = ["!#$%&()*+,-./:;<=>?@[]^_`{|}~"]
ENDINGS = {"latin": ("na", "n"), "cyrillic": ("на", "н")}
#: Other letters stand for those of their block of so many code points.
BLOCK = 64
ROUNDS = 4


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), use)[0]


def _number(parts: list[Column]) -> Column:
    """A keyed 56-bit number."""
    return F.conv(F.substring(F.sha2(F.concat_ws("|", *parts).cast("binary"), 256), 1, 14), 16, 10).cast("long")


def _feistel(a: Column, b: Column, mod_a: Column, mod_b: Column, key: list[Column]) -> Column:
    """A permutation of the pairs (a, b) below (mod_a, mod_b)."""

    def step(i: int):
        if i % 2 == 0:
            return lambda s: F.struct(F.pmod(s["a"] + F.pmod(_number([*key, F.lit(i), s["b"].cast("string")]), s["ma"]), s["ma"]).alias("a"), s["b"].alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"))
        return lambda s: F.struct(s["a"].alias("a"), F.pmod(s["b"] + F.pmod(_number([*key, F.lit(i), s["a"].cast("string")]), s["mb"]), s["mb"]).alias("b"), s["ma"].alias("ma"), s["mb"].alias("mb"))

    state = F.struct(a.alias("a"), b.alias("b"), mod_a.alias("ma"), mod_b.alias("mb"))
    return reduce(_let, [step(i) for i in range(4)], state)


def _refill(entity: Column, digits: Column) -> Column:
    """``entity`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("k"))

    def put(acc: Column, c: Column) -> Column:
        digit = c.between("0", "9")
        return F.struct(F.concat(acc["out"], F.when(digit, F.substring(digits, acc["k"], F.lit(1))).otherwise(c)).alias("out"), (acc["k"] + digit.cast("int")).alias("k"))

    return F.aggregate(F.split(entity, ""), start, put, lambda acc: acc["out"])


def _digits(entity: Column, keep: Column, check: Column, key: list[Column]) -> Column:
    """Digits permuted but for the first ``keep``; where ``check``, the last is the check digit."""
    d = F.regexp_replace(entity, "[^0-9]", "")

    def use(s: Column) -> Column:
        size = F.length(s["d"]) - s["keep"] - F.when(s["check"], 1).otherwise(0)
        head, tail = F.substring(s["d"], F.lit(1), s["keep"]), F.substring(s["d"], s["keep"] + 1, size)

        def halves(t: Column) -> Column:
            n = F.length(t)
            u = F.floor(n / 2).cast("int")
            ten = lambda k: F.pow(F.lit(10.0), k).cast("long")
            out = _feistel(F.coalesce(F.substring(t, F.lit(1), u).try_cast("long"), F.lit(0)), F.substring(t, u + 1, F.lit(40)).cast("long"), ten(u), ten(n - u), [*key, n.cast("string"), head])
            return _let(out, lambda r: F.concat(F.when(u > 0, F.lpad(r["a"].cast("string"), u, F.lit("0"))).otherwise(""), F.lpad(r["b"].cast("string"), n - u, F.lit("0"))))

        checked = lambda x: F.concat(x, F.when(s["check"], F.pmod(-_luhn(F.concat(x, F.lit("0"))), F.lit(10)).cast("string")).otherwise(""))
        return _refill(s["e"], _let(F.concat(head, _let(tail, halves)), checked))

    return _let(F.struct(d.alias("d"), keep.cast("int").alias("keep"), check.alias("check"), entity.alias("e")), use)


def _luhn(digits: Column) -> Column:
    """The sum of a number's digits, every second from the right doubled and cast out."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(i % 2 == 0, c.cast("int")).otherwise(2 * c.cast("int") - F.when(c >= "5", 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda x, y: x + y)


def _ip(entity: Column, key: list[Column]) -> Column:
    o = F.transform(F.split(entity, r"\."), lambda x: x.cast("long"))
    out = _let(o, lambda v: _feistel(v[0] * 256 + v[1], v[2] * 256 + v[3], F.lit(65536).cast("long"), F.lit(65536).cast("long"), key))
    return _let(out, lambda r: F.concat_ws(".", F.shiftright(r["a"], 8).cast("string"), r["a"].bitwiseAND(255).cast("string"), F.shiftright(r["b"], 8).cast("string"), r["b"].bitwiseAND(255).cast("string")))


def _stream(key: list[Column], half: Column, n: Column) -> Column:
    """Keyed hexadecimal digits, four at least for each of ``n`` characters."""
    return F.array_join(F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda i: F.sha2(F.concat_ws("|", *key, i.cast("string"), half).cast("binary"), 256)), "")


def _permuted(text: Column, alphabets: list[str], key: list[Column]) -> Column:
    """A permutation of the texts of one pattern of alphabets: a Feistel network
    whose halves are those of the text, added character by character. Other
    characters beyond ASCII move within their block, the rest of ASCII stays."""

    def code(c: Column) -> Column:
        point = F.ascii(c)
        low = F.when(point < 192, 160).otherwise(point - F.pmod(point, F.lit(BLOCK)))
        out = F.when(point >= 160, F.struct((point - low).alias("v"), F.when(point < 192, 32).otherwise(BLOCK).alias("m"), low.alias("b")))
        out = out.otherwise(F.struct(F.lit(0).alias("v"), F.lit(1).alias("m"), point.alias("b")))
        for k, a in reversed(list(enumerate(alphabets))):
            at = F.instr(F.lit(a), c)
            out = F.when(at > 0, F.struct((at - 1).alias("v"), F.lit(len(a)).alias("m"), F.lit(-1 - k).alias("b"))).otherwise(out)
        return out

    def char(x: Column) -> Column:
        out = F.decode(F.unhex(F.lpad(F.hex((x["b"] + x["v"]).cast("long")), 8, "0")), "UTF-32")
        for k, a in enumerate(alphabets):
            out = F.when(x["b"] == -1 - k, F.substring(F.lit(a), x["v"] + 1, F.lit(1))).otherwise(out)
        return out

    def moved(half: Column, other: Column, i: int) -> Column:
        seed = F.array_join(F.transform(other, lambda x: F.concat(x["b"].cast("string"), F.lit("."), x["v"].cast("string"))), ",")
        add = lambda r: F.transform(half, lambda x, k: F.struct(F.pmod(x["v"] + F.conv(F.substring(r, 4 * k + 1, F.lit(4)), 16, 10).cast("int"), x["m"]).alias("v"), x["m"].alias("m"), x["b"].alias("b")))
        return _let(_stream([*key, F.lit(str(i))], seed, F.size(half)), add)

    def step(i: int):
        if i % 2 == 0:
            return lambda s: F.struct(moved(s["l"], s["r"], i).alias("l"), s["r"].alias("r"))
        return lambda s: F.struct(s["l"].alias("l"), moved(s["r"], s["l"], i).alias("r"))

    def cut(codes: Column) -> Column:
        u = F.floor(F.size(codes) / 2).cast("int")
        return F.struct(F.slice(codes, F.lit(1), u).alias("l"), F.slice(codes, u + 1, F.size(codes)).alias("r"))

    codes = F.transform(F.filter(F.split(text, ""), lambda c: c != ""), code)
    state = reduce(_let, [step(i) for i in range(4)], _let(codes, cut))
    return _let(state, lambda s: F.array_join(F.transform(F.concat(s["l"], s["r"]), char), ""))


def _secret(entity: Column, key: list[Column]) -> Column:
    """Characters of the same kind. Which alphabets hold is seen alike in the surrogate."""
    hexadecimal, spoken = entity.rlike("^[0-9a-f]{16,}$"), entity.rlike(r"[^\x00-\x7F]|[0-9A-Za-z]")
    return F.when(hexadecimal, _permuted(entity, HEXADECIMAL, key)).when(spoken, _permuted(entity, ALPHABETS, key)).otherwise(_permuted(entity, PUNCTUATION, key))


def _email(entity: Column, key: list[Column]) -> Column:
    local, domain = F.lower(F.substring_index(entity, "@", 1)), F.lower(F.substring_index(entity, "@", -1))
    top = F.substring_index(domain, ".", -1)
    host = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    return F.concat(_permuted(local, ALPHABETS, [*key, domain]), F.lit("@"), _permuted(host, ALPHABETS, key), F.lit(".example."), top)


def _name(entity: Column, female: Column, key: list[Column]) -> Column:
    def ended(word: Column, script: str) -> Column:
        return F.concat(_permuted(word, SPOKEN, key), F.when(female, ENDINGS[script][0]).otherwise(ENDINGS[script][1]))

    def one(w: Column) -> Column:
        return F.when(~w.rlike(r"^\p{Lu}"), w).when(w.endswith("."), _permuted(w, SPOKEN, key)).when(w.rlike(r"^\p{IsCyrillic}"), ended(w, "cyrillic")).otherwise(ended(w, "latin"))

    return F.array_join(F.transform(F.split(entity, " "), one), " ")


def kind(entity: Column) -> Column:
    """The type of an entity, which stands before its first colon."""
    return F.substring_index(entity, ":", 1)


def _value(entity: Column) -> Column:
    return F.substring(entity, F.length(kind(entity)) + 2, F.length(entity))


def _shape(found: Column) -> Column:
    """The type of what was found without a title or keyword; ``none`` for numbers that are no card."""
    digits = F.regexp_replace(found, "[ \\-]", "")
    return (
        F.when(found.rlike(r"^[A-Za-z0-9._%+\-]+@[A-Za-z0-9.\-]+\.[A-Za-z]{2,63}$"), "email")
        .when(found.rlike(r"^(?:[0-9]{1,3}\.){3}[0-9]{1,3}$|^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ip")
        .when(found.rlike("^[0-9]{3}-[0-9]{2}-[0-9]{4}$"), "ssn")
        .when(found.rlike(r"^\+[0-9 \s().\-]+$|^\(?[0-9]{3}\)?[ .\-][0-9]{3}[ .\-][0-9]{4}$"), "phone")
        .when(found.rlike(r"^[0-9](?:[ \-]?[0-9]){12,18}$"), F.when(digits.rlike(ISSUER) & (_luhn(digits) % 10 == 0), "card").otherwise("none"))
        .otherwise("secret")
    )


def surrogate(entity: Column, key: str, turn: int = 0) -> Column:
    """The replacement of an entity, given as ``type:value``, names as ``name:f:value`` or ``name:m:value``."""
    base = [F.lit(key), F.lit(str(turn))]

    def put(s: Column) -> Column:
        k, v = s["k"], s["v"]
        of = lambda t: [*base, F.lit(t)]
        country = F.when(v.startswith("+"), F.length(F.regexp_extract(v, r"^\+([0-9]{1,3}?)(?:[\s.\-(]|[0-9]{10}$)", 1))).otherwise(0)
        kept = F.when(k == "phone", country).when(k == "card", 4).otherwise(0)
        return (
            F.when(k == "email", _email(v, of("email")))
            .when(k.isin("phone", "card", "ssn"), _digits(v, kept, k == "card", [*base, k]))
            .when((k == "ip") & v.contains(":"), _permuted(F.lower(v), HEXADECIMAL, of("ip")))
            .when(k == "ip", _ip(v, of("ip")))
            .when(k == "name", _name(F.substring(v, F.lit(3), F.length(v)), v.startswith("f:"), of("name")))
            .when(k == "secret", _secret(v, of("secret")))
            .otherwise(v)
        )

    return _let(F.struct(kind(entity).alias("k"), _value(entity).alias("v")), put)


TITLES = ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Señor", "Monsieur", "Madame", "Госп")


def _split(text: Column) -> Column:
    """``e``, the entities in order as ``surrogate`` takes them, and ``p``, the text
    around them; null where there is none. Texts without a digit, an at-sign, a
    colon, an equals sign, a title, a key's prefix or a long run of hexadecimal
    letters cannot have any and are not searched."""
    titled = reduce(lambda a, b: a | b, [text.contains(t) for t in TITLES])
    maybe = titled | text.rlike(f"[0-9@=:]|[a-f]{{32}}|[A-F]{{32}}|AKIA|{_KEY_STARTS}")
    single = lambda w: w.rlike(r"^\p{Lu}[\p{L}\p{M}'’\-]+$")
    found = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(PATTERNS["name"]), F.lit(0)), lambda n: F.split(n, " ")))
    # In descending order a word comes before its own beginnings.
    words = F.when(titled, F.sort_array(F.array_distinct(F.filter(found, single)), asc=False)).otherwise(F.array().cast("array<string>"))
    mention = lambda w: F.concat(F.lit(ENTITY + r"|(?<![\p{L}\p{M}\p{N}_])(?:"), F.array_join(w, "|"), F.lit(r")(?![\p{L}\p{M}\p{N}_])"))

    def search(w: Column) -> Column:
        pattern = F.when(F.size(w) > 0, mention(w)).otherwise(F.lit(ENTITY))
        return _let(pattern, lambda r: _let(F.struct(F.regexp_extract_all(text, r, F.lit(0)).alias("f"), r.alias("r"), w.alias("w")), cut))

    def cut(s: Column) -> Column:
        return F.when(F.size(s["f"]) > 0, _let(F.struct(s["f"].alias("f"), F.split(text, s["r"], -1).alias("p"), s["w"].alias("w")), pair))

    def pair(s: Column) -> Column:
        def look(f: Column, before: Column) -> Column:
            head = F.regexp_extract(f, HEAD, 0)
            name = (head == "") & f.rlike(f"^{NAME}$") & (before.rlike(rf"(?:{TITLE})\.? $") | F.array_contains(s["w"], f))
            gender = F.when(~name, "").when(before.rlike(FEMALE), "f:").when(before.rlike(MALE), "m:").otherwise("?")
            entity = F.substring(f, F.length(head) + 1, F.length(f))
            of = F.when(head != "", "secret").when(name, "name").otherwise(_shape(entity))
            return F.struct(before.alias("b"), head.alias("h"), entity.alias("e"), gender.alias("g"), of.alias("t"))

        return _let(F.zip_with(s["f"], F.slice(s["p"], 1, F.size(s["f"])), look), lambda each: gendered(each, F.element_at(s["p"], -1)))

    def gendered(each: Column, end: Column) -> Column:
        known = F.flatten(F.transform(F.filter(each, lambda x: x["g"].isin("f:", "m:")), lambda x: F.transform(F.split(x["e"], " "), lambda w: F.struct(w.alias("w"), x["g"].alias("g")))))

        def full(x: Column, k: Column) -> Column:
            own = F.get(F.filter(k, lambda y: F.array_contains(F.split(x["e"], " "), y["w"])), F.lit(0))["g"]
            return F.concat(x["t"], F.lit(":"), F.when(x["g"] == "?", F.coalesce(own, F.lit("m:"))).otherwise(x["g"]), x["e"])

        return F.struct(_let(known, lambda k: F.transform(each, lambda x: full(x, k))).alias("e"), F.concat(F.transform(each, lambda x: F.concat(x["b"], x["h"])), F.array(end)).alias("p"))

    return F.when(maybe, _let(words, search))


def entities(text: Column) -> Column:
    """The entities of a text in order; null if it has none."""
    return F.filter(_split(text)["e"], lambda e: kind(e) != "none")


def distinct_entities(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``entity``, each of the corpus once; addresses in lower case."""
    each = df.select(F.explode(entities(F.col(text_col))).alias("entity")).distinct()
    canon = F.when(kind(F.col("entity")).isin("email", "ip"), F.lower("entity")).otherwise(F.col("entity"))
    return each.select(canon.alias("entity")).distinct()


def collisions(each: DataFrame, key: str, turn: int) -> DataFrame:
    """Surrogates, by type, that two of the entities share or that are an entity, with their number."""
    made = each.select(kind(F.col("entity")).alias("kind"), surrogate(F.col("entity"), key, turn).alias("surrogate"), F.lit(1).alias("made"))
    real = each.select(kind(F.col("entity")).alias("kind"), F.regexp_replace(_value(F.col("entity")), "^[fm]:", "").alias("surrogate"), F.lit(0).alias("made"))
    both = made.union(real.distinct()).groupBy("kind", "surrogate").agg(F.count("*").alias("n"), F.sum("made").alias("made"))
    return both.where("n > 1 and made > 0")


def choose_round(df: DataFrame, key: str, text_col: str = "text") -> int:
    """The first turn of the key without collisions, or else the one with the fewest."""
    each, least = stored(distinct_entities(df, text_col), "pii-entities"), []
    for turn in range(ROUNDS):
        least.append(collisions(each, key, turn).count())
        if not least[-1]:
            return turn
    return min(range(ROUNDS), key=least.__getitem__)


def replace(df: DataFrame, key: str, text_col: str = "text", check: bool = True) -> DataFrame:
    """``df`` with its text's entities replaced, and ``pii``: how many
    of each type; a column of that name gives way."""
    turn = choose_round(df, key, text_col) if check else 0
    text = F.col("_row")[text_col]
    join = lambda s: F.array_join(F.zip_with(s["p"], F.transform(s["e"], lambda e: surrogate(e, key, turn)), lambda p, x: F.concat(p, F.coalesce(x, F.lit("")))), "")
    done = F.struct(_let(_split(text), lambda s: F.struct(F.when(s["p"].isNotNull(), join(s)).alias("text"), F.coalesce(F.transform(s["e"], lambda e: kind(e)), F.array().cast("array<string>")).alias("kinds"))).alias("x"))
    found = df.select(F.struct(*df.columns).alias("_row")).withColumn("_x", done["x"])
    count = lambda t: F.size(F.filter(F.col("_x.kinds"), lambda k: k == t))
    out = F.coalesce(F.col("_x.text"), text).alias(text_col)
    kept = [out if c == text_col else F.col("_row")[c].alias(c) for c in df.columns if c != "pii"]
    return found.select(*kept, F.struct(*[count(t).alias(t) for t in PATTERNS]).alias("pii"))
