"""Surrogates for personal data, on DataFrame functions alone.

Entities are found by one pattern and replaced by values drawn from a keyed digest (HMAC) of their
type and canonical form: the same entity gets the same surrogate wherever it stands and however it
is written (coreference), letters stay letters of their script and case, digits stay digits in
their places, card numbers keep their check digit valid and addresses stay addresses.  A name is
replaced word by word: given names by others of the same gender and script, in a keyed order that
no two share; all its other words by surnames of the same script, gender and case.  Words of a
name that come again in the same text, alone, are entities too.  The distinct entities form a
dictionary; where two of them draw one surrogate, or a surrogate is itself an entity of the
corpus, the later ones draw again, until all differ (distinctness).  Forms that leave too little
to draw from, such as masked secrets, are drawn as letters and grow with further draws.

Found: e-mail addresses, IPv4 addresses, international and dashed telephone numbers, payment
card numbers with a valid check digit, social security numbers, account numbers (IBAN), quoted secrets behind a key word,
and names: a known given name or a frequent East Asian family name before capitalised words, or
capitalised words behind a title or a phrase such as "my name is".

Defined results: null and empty texts stay as they are; a text without entities is returned
unchanged, byte for byte; repeated rows get equal results; other columns pass through, and a
column that is added gets underscores where its name is taken.
"""

from __future__ import annotations

import hmac
import itertools
import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm.common import free, materialize, table

#: Setting that holds the secret key of a deployment.
KEY_SETTING = "spark.placeloom.pii.key"
#: Entities that had to draw again and are carried in the plan; more are joined.
INLINE_REDRAWS = 500
#: Attempts after which a surrogate grows.
GROWS = 3

#: Given names by gender and script.
FEMALE = {
    "latin": "Mary Anna Maria María Julia Laura Emma Sophie Claire Elena Lucia Carmen Isabel Katharina Petra Sabine Monique Camille Linda Susan Patricia Barbara Elizabeth Jennifer Sarah Karen",
    "cyrillic": "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Дарья Полина",
}
MALE = {
    "latin": "James John Robert Michael William David Thomas Daniel Peter Paul Hans Klaus Jürgen Stefan Pierre Jean Jacques Michel Carlos José Antonio Manuel Javier Miguel Richard",
    "cyrillic": "Александр Сергей Дмитрий Андрей Алексей Иван Михаил Николай Владимир Павел Юрий Олег",
}
#: Parts of surnames by script and gender.
HEADS = {
    "latin": "Bar Cor Dal Fen Gar Hol Kel Lin Mor Nor Pel Ros Sal Tor Val Wes",
    "cyrillic": "Бар Вол Гор Дан Жар Зор Кал Лар Мор Нов Пет Рос Сав Тар Хар Яр",
}
TAILS = {
    "latin": "ton berg man well mont dale ner ley sen rick gan vey lard quist stone by",
    "cyrillic": "енко овский ин ов ев ский ук чук ян ец ман ко ур ник ай ис",
    "cyrillic_f": "енко овская ина ова ева ская ук чук ян ец ман ко ур ник ай ис",
}
#: Family names that stand before the given name, titles, phrases before a name, and
#: small words inside names.
FIRST_FAMILY = "Wang Zhang Liu Chen Yang Huang Zhao Zhou Kim Choi Nguyen Tran Sato Suzuki Tanaka Yamamoto Watanabe"
TITLES = "Mr Mrs Ms Miss Dr Prof Herr Frau Señor Señora Sr Sra Don Doña Monsieur Madame Mme Mlle Signor Signora Sir Lady"
PHRASES = ("my name is", "name:", "mein name ist", "ich heiße", "je m'appelle", "me llamo", "mi nombre es")
PARTICLES = ("de la", "de los", "de las", "de", "del", "della", "di", "da", "dos", "das", "du", "van der", "van den", "van", "von der", "von", "zu", "ten", "ter", "bin", "ibn", "al", "y")
#: First and last letter of a range, and the letters that are drawn for it.
ALPHABETS = [
    ("a", "z", "abcdefghijklmnopqrstuvwxyz"),
    ("A", "Z", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("à", "ÿ", "abcdefghijklmnopqrstuvwxyz"),
    ("À", "Þ", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("а", "џ", "абвгдежзиклмнопрстуфхцчшыэюя"),
    ("Ѐ", "Я", "АБВГДЕЖЗИКЛМНОПРСТУФХЦЧШЫЭЮЯ"),
    ("ά", "ώ", "αβγδεζηθικλμνξοπρστυφχψω"),
    ("Ά", "Ϋ", "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"),
    ("א", "ת", "אבגדהוזחטיכלמנסעפצקרשת"),
    ("ء", "ي", "بتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    ("अ", "ह", "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह"),
    ("ぁ", "ん", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめもやゆよらりるれろわ"),
    ("ァ", "ン", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモヤユヨラリルレロワ"),
    ("가", "힣", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호구누두루무부수우주추쿠투푸후"),
    ("一", "鿿", "王李张刘陈杨黄赵周吴徐孙朱马胡郭林何高梁郑罗宋谢唐韩曹许邓萧冯曾程蔡彭潘袁于董余苏叶吕魏蒋田杜丁沈姜范江傅钟卢汪戴崔任陆廖姚方金邱夏谭韦贾邹石熊孟秦"),
]
_LOWER = ALPHABETS[0][2]

_GIVEN = {(g, s): names.split() for g, by in (("f", FEMALE), ("m", MALE)) for s, names in by.items()}
_NAMES = "|".join(itertools.chain.from_iterable(_GIVEN.values()))
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_MAILBOX = r"[\p{L}\p{N}._%+-]++@(?:[\p{L}\p{N}-]{1,63}\.){1,126}[\p{L}\p{N}-]{2,63}"
#: One capitalised word, words joined by hyphens, and further words of a name.
_WORD = r"\p{Lu}\p{L}*+(?:['’]\p{L}++){0,2}"
_JOINED = rf"{_WORD}(?:-{_WORD}){{0,3}}"
_MORE = rf" (?:(?:{'|'.join(PARTICLES)}) )?{_JOINED}"
_TITLED = rf"(?:{'|'.join(TITLES.split())})\.? (?:(?:{'|'.join(PARTICLES)}) )?{_JOINED}(?:{_MORE}){{0,3}}"
_SAID = rf"(?i:{'|'.join(PHRASES)}) {_JOINED}(?:{_MORE}){{0,3}}"
_KNOWN = rf"(?:{_NAMES})(?:-{_WORD}){{0,2}}(?:{_MORE}){{1,3}}|(?:{'|'.join(FIRST_FAMILY.split())}) {_JOINED}"
#: What each type looks like, in order of precedence.
PATTERNS = {
    "email": rf"(?<![\p{{L}}\p{{N}}._%+-]){_MAILBOX}",
    "secret": r"(?<=[\"'])(?<=(?i:token|secret|passw|pwd|key|word)[\"']? ?[=:] ?[\"'])[^\"'\s]{8,}+(?=[\"'])",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "iban": r"(?=[A-Z]{2}[0-9]{2})(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "card": r"(?<![0-9+.-])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "phone": r"(?<![0-9+])(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,4}|\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4})(?![0-9])",
    "name": rf"(?=\p{{L}})(?<!\p{{L}})(?:(?=\p{{Lu}}[\p{{L}}'’.-]*+ [\p{{L}} ]{{0,8}}\p{{Lu}})(?:{_TITLED}|{_KNOWN})|(?=[A-Za-z]\p{{L}}++[ :]){_SAID})",
}
_NUMBERS = ("ip", "card", "ssn", "phone")
#: All types as one pattern; each starts with a test of one character, so most places cost little.
PATTERN = "|".join(
    [f"(?:{PATTERNS[k]})" for k in ("email", "secret", "iban", "name")] + ["(?=[0-9+(])(?:" + "|".join(f"(?:{PATTERNS[k]})" for k in _NUMBERS) + ")"]
)
#: Words of an entity of the type name that stay.
_KEPT = [x.lower() for x in (*TITLES.split(), *" ".join(PHRASES).replace(":", "").replace("'", " ").split())]


def key_of(spark: SparkSession) -> str:
    """The deployment's key; a public one, for demonstrations, where none is set."""
    return spark.conf.get(KEY_SETTING, None) or "demonstration"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _digest(key: str, message: Column) -> Column:
    """HMAC-SHA512 of a message, in hexadecimal digits."""
    padded = key.encode()
    padded = (hmac.new(b"", padded, "sha512").digest() if len(padded) > 128 else padded).ljust(128, b"\0")
    inner, outer = (F.unhex(F.lit(bytes(x ^ pad for x in padded).hex())) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(message, "UTF-8")), 512))), 512)


def _given_names(key: str) -> dict[str, str]:
    """A keyed substitute for every known given name, in lower case: the next one of its gender and script."""
    out = {}
    for names in _GIVEN.values():
        order = sorted((x.lower() for x in names), key=lambda x: hmac.new(key.encode(), f"given|{x}".encode(), "sha512").digest())
        out.update(zip(order, [*order[1:], order[0]]))
    return out


def _unchecked(entity: Column) -> Column:
    """Whether an entity looks like a card number, but its check digit is wrong."""
    return entity.rlike(SHAPES["card"]) & _let(F.regexp_replace(entity, "[^0-9]", ""), lambda d: _luhn_sum(d) % 10 != 0)


#: What tells the types of found entities apart; all others are secrets.
SHAPES = {
    "ip": r"^[0-9]{1,3}(?:\.[0-9]{1,3}){3}$",
    "iban": "^[A-Z]{2}[0-9]{2}[A-Z0-9 ]{10,}$",
    "card": "^[0-9 -]{13,}$",
    "ssn": "^[0-9]{3}-[0-9]{2}-[0-9]{4}$",
    "phone": "^[0-9+(][0-9 ().-]+$",
}


def kind_of(entity: Column, again: Column | None = None) -> Column:
    """Type of a found entity, or none; ``again`` are words of names that may stand alone."""
    out = F.when(F.array_contains(again, entity), "name") if again is not None else F
    out = out.when(entity.contains("@") & entity.rlike(f"^{_MAILBOX}$"), "email")
    # secrets have no space, all other types with one have digits
    out = out.when(entity.contains(" ") & ~entity.rlike("[0-9]"), "name").when(_unchecked(entity), "none")
    for kind, shape in SHAPES.items():
        out = out.when(entity.rlike(shape), kind)
    return out.otherwise("secret")


def canonical(kind: Column, entity: Column) -> Column:
    """One form for all ways to write an entity, or a word of a name."""
    return (
        F.when(kind.isin("card", "ssn", "phone"), F.regexp_replace(entity, "[^0-9]", ""))
        .when(kind == "iban", F.regexp_replace(entity, " ", ""))
        .when(kind.isin("email", "word"), F.lower(entity))
        .otherwise(entity)
    )


def _draw(digest: Column, i: Column | int, n: int) -> Column:
    """The ``i``-th number below ``n`` of a digest."""
    at = F.pmod(F.lit(i) if isinstance(i, int) else i, F.lit(31)) * 4 + 1
    return F.pmod(F.conv(F.substring(digest, at, F.lit(4)), 16, 10).cast("int"), F.lit(n))


def _letter(digest: Column, i: Column) -> Column:
    return F.substring(F.lit(_LOWER), _draw(digest, i, 26) + 1, F.lit(1))


def _alike(digest: Column, i: Column, c: Column) -> Column:
    """A letter of ``c``'s script and case; of other scripts a Latin one."""
    ranges = F.from_json(F.lit(json.dumps([{"a": a, "z": z, "letters": x} for a, z, x in ALPHABETS])), "array<struct<a:string,z:string,letters:string>>")
    own = F.coalesce(F.get(F.filter(ranges, lambda r: c.between(r["a"], r["z"])), F.lit(0))["letters"], F.lit(_LOWER))
    return _let(own, lambda x: F.substring(x, F.pmod(_draw(digest, i, 1 << 16), F.length(x)) + 1, F.lit(1)))


def _like(digest: Column, text: Column) -> Column:
    """``text`` with its letters and digits drawn anew, hexadecimal texts as such, all else kept.

    A text without letters and digits is drawn as letters.
    """

    def made(mode: Column) -> Column:
        def char(c: Column, i: Column) -> Column:
            # past the digest's end, blocks of further digests follow
            block = F.when(i < 31, digest).otherwise(F.sha2(F.concat(digest, (i / 31).cast("int").cast("string")), 512))
            return _let(block, lambda d: _char(mode, d, i, c))

        return F.array_join(F.transform(F.split(text, ""), char), "")

    mode = F.when(text.rlike("^[0-9a-f]+$"), "hex").when(text.rlike("^[0-9A-F]+$"), "HEX").when(text.rlike(r"[\p{L}\p{N}]"), "text").otherwise("none")
    return _let(mode, made)


def _char(mode: Column, digest: Column, i: Column, c: Column) -> Column:
    six = F.hex(_draw(digest, i, 16))
    return (
        F.when(mode == "hex", F.lower(six))
        .when(mode == "HEX", six)
        .when(mode == "none", _letter(digest, i))
        .when(c.rlike(r"\p{N}"), _draw(digest, i, 10).cast("string"))
        .when(c.rlike(r"\p{L}"), _alike(digest, i, c))
        .otherwise(c)
    )


def _digits(digest: Column, digits: Column, kept: Column) -> Column:
    """As many digits drawn anew, the first ``kept`` of them as they were."""
    return F.array_join(
        F.transform(
            F.sequence(F.lit(1), F.length(digits)),
            lambda i: F.when(i <= kept, F.substring(digits, i, F.lit(1))).otherwise(_draw(digest, i, 10).cast("string")),
        ),
        "",
    )


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a number whose check digit comes last."""
    n = F.length(digits)

    def add(total: Column, i: Column) -> Column:
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when((n - i) % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), n), F.lit(0), add)


def _with_check(digits: Column) -> Column:
    """``digits`` with the last one set so that the Luhn sum ends in 0."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)
    return F.concat(body, F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))


def _refilled(entity: Column, digits: Column) -> Column:
    """``entity`` with its digits replaced in turn."""

    def put(acc: Column, c: Column) -> Column:
        is_digit = c.rlike("[0-9]")
        return F.struct(
            F.concat(acc["out"], F.when(is_digit, F.substring(digits, acc["i"], F.lit(1))).otherwise(c)).alias("out"),
            (acc["i"] + is_digit.cast("int")).alias("i"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("i"))
    return F.aggregate(F.split(entity, ""), start, put)["out"]


def _surname(digest: Column, plain: Column, attempt: Column) -> Column:
    """A surname of the same script and gender, in lower case; each new attempt adds a part.  Other scripts are drawn letter by letter."""

    def made(script: str, tails: str) -> Column:
        pick = lambda values, i: F.element_at(F.array(*map(F.lit, values.lower().split())), _draw(digest, i, len(values.split())) + 1)
        more = F.array_join(F.transform(F.sequence(F.lit(0), attempt), lambda i: pick(HEADS[script], i + 5)), "")
        return F.concat(pick(HEADS[script], 1), more, pick(TAILS[tails], 2))

    return (
        F.when(plain.rlike(r"^[\p{IsLatin}'’]+$"), made("latin", "latin"))
        .when(plain.rlike(r"^[\p{IsCyrillic}]+(?:ова|ева|ина|ская)$"), made("cyrillic", "cyrillic_f"))
        .when(plain.rlike(r"^[\p{IsCyrillic}'’]+$"), made("cyrillic", "cyrillic"))
        .otherwise(F.lower(_like(digest, plain)))
    )


def _keyed(kind: Column, plain: Column, attempt: Column, key: str, body) -> Column:
    """``body`` of the digest of an entity, and what late attempts add."""
    return _let(_digest(key, F.concat_ws("|", kind, plain, attempt.cast("string"))), lambda d: F.concat(body(d), _grown(kind, d, attempt)))


def word_surrogate(plain: Column, attempt: Column, key: str) -> Column:
    """The surrogate of a word of a name, both in lower case."""
    return _keyed(F.lit("word"), plain, attempt, key, lambda d: _surname(d, plain, attempt))


def surrogate(kind: Column, entity: Column, attempt: Column, key: str) -> Column:
    """The surrogate of an entity other than a name, in the entity's own spelling."""
    return _let(canonical(kind, entity), lambda plain: _keyed(kind, plain, attempt, key, lambda d: _drawn(kind, entity, plain, d)))


def _grown(kind: Column, digest: Column, attempt: Column) -> Column:
    """What late attempts add: four digits or letters each."""
    numeric = kind.isin(*_NUMBERS)
    each = lambda i: F.when(numeric, _draw(digest, i + 7, 10).cast("string")).otherwise(_letter(digest, i + 7))
    return F.when(attempt > GROWS, F.array_join(F.transform(F.sequence(F.lit(1), 4 * (attempt - GROWS)), each), "")).otherwise("")


def _drawn(kind: Column, entity: Column, plain: Column, digest: Column) -> Column:
    octet = lambda i: (_draw(digest, i, 254) + 1).cast("string")
    country = F.length(F.regexp_extract(entity, r"^\+([0-9]{1,3})(?:[ .-]|\()", 1))
    kept = F.when(kind == "card", 1).when(kind == "phone", country).otherwise(0)
    checked = lambda d: F.when(kind == "card", _with_check(d)).otherwise(d)
    number = _let(_let(_digits(digest, plain, kept), checked), lambda d: _refilled(entity, d))
    mailbox = F.concat(F.substring_index(plain, "@", 1), F.lit("@"), F.substring_index(F.substring_index(plain, "@", -1), ".", 1))
    shape = F.when(kind == "email", mailbox).when(kind == "iban", F.substring(entity, F.lit(3), F.length(entity))).otherwise(entity)
    lettered = _let(shape, lambda s: _like(digest, s))
    return (
        F.when(kind == "ip", F.concat_ws(".", octet(0), octet(1), octet(2), octet(3)))
        .when(kind.isin("card", "ssn", "phone"), number)
        .otherwise(F.concat(F.when(kind == "iban", F.substring(entity, 1, 2)).otherwise(""), lettered, F.when(kind == "email", ".example").otherwise("")))
    )


def _words(name: Column) -> Column:
    """The words of an entity of the type name that are replaced."""
    return F.filter(F.regexp_extract_all(name, F.lit(_WORD), F.lit(0)), lambda w: ~F.lower(w).isin(_KEPT))


def _again(found: Column) -> Column:
    """Words of the names among a text's entities, which may stand alone; of two letters at least."""
    names = F.filter(found, lambda e: kind_of(e) == "name")
    return F.filter(F.array_distinct(F.flatten(F.transform(names, _words))), lambda w: F.length(w) > 1)


def _pattern(again: Column) -> Column:
    """The pattern of a text's entities and of the words of its names."""
    alone = F.concat(F.lit(PATTERN + r"|(?=\p{Lu})(?<!\p{L})(?:"), F.array_join(again, "|"), F.lit(r")(?!\p{L})"))
    return F.when(F.size(again) > 0, alone).otherwise(F.lit(PATTERN))


def _marked(docs: DataFrame) -> tuple[DataFrame, Column, Column]:
    """``docs`` with the entities of each text and the words of its names."""
    text = F.col("text").cast("string")
    found, again = free(docs, "found"), free(docs, "again")
    none = F.array().cast("array<string>")
    out = docs.withColumn(found, F.coalesce(F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)), none))
    out = out.withColumn(again, F.when(F.size(found) > 0, _again(F.col(found))).otherwise(none))
    out = out.withColumn(found, F.when(F.size(again) > 0, F.regexp_extract_all(text, _pattern(F.col(again)), F.lit(0))).otherwise(F.col(found)))
    return out, F.col(found), F.col(again)


def _atoms(found: Column, again: Column) -> Column:
    """(kind, plain) of the entities of a text; a name gives its words, but for known given names."""
    known = sorted(_given_names(""))
    pair = lambda kind, plain: F.struct(kind.alias("kind"), plain.alias("plain"))
    words = lambda e: F.transform(F.filter(_words(e), lambda w: ~F.lower(w).isin(known)), lambda w: pair(F.lit("word"), F.lower(w)))
    one = lambda e: _let(kind_of(e, again), lambda kind: F.when(kind == "name", words(e)).otherwise(F.array(pair(kind, canonical(kind, e)))))
    return F.flatten(F.transform(found, one))


def entities(docs: DataFrame) -> DataFrame:
    """(kind, plain) of every distinct entity of the texts; of names, every word that is no known given name."""
    marked, found, again = _marked(docs.select(F.col("text").cast("string").alias("text")))
    each = marked.where(F.size(found) > 0).select(F.explode(F.array_distinct(_atoms(found, again))).alias("e"))
    return each.select("e.kind", "e.plain").where("kind <> 'none'").distinct()


def dictionary(docs: DataFrame, key: str) -> DataFrame:
    """(kind, plain, attempt) of every distinct entity, with attempts that make the surrogates differ."""
    known = materialize(entities(docs).withColumn("attempt", F.lit(0)), "entities")
    kind, plain, attempt = F.col("kind"), F.col("plain"), F.col("attempt")
    own = F.when(kind == "word", word_surrogate(plain, attempt, key)).otherwise(canonical(kind, surrogate(kind, plain, attempt, key)))
    settled: DataFrame | None = None
    fresh = known
    # surrogates grow with the attempts, so this ends
    while True:
        drawn = materialize(fresh.select("kind", "plain", "attempt", own.alias("drawn")), "drawn")
        drawn = drawn if settled is None else drawn.unionByName(settled)
        # of those that drew one surrogate the smallest keeps it; one that is a real entity is given up
        firsts = drawn.groupBy("kind", "drawn").agg(F.min("plain").alias("keeper"), F.count("*").alias("n")).where("n > 1")
        real = known.select("kind", F.col("plain").alias("drawn"), F.lit(True).alias("taken"))
        judged = drawn.join(firsts, ["kind", "drawn"], "left").join(real, ["kind", "drawn"], "left")
        again = F.coalesce((F.col("n") > 1) & (plain != F.col("keeper")), F.lit(False)) | F.coalesce(F.col("taken"), F.lit(False))
        judged = materialize(judged.select("kind", "plain", "attempt", "drawn", again.alias("again")), "judged")
        settled = judged.where("NOT again").drop("again")
        fresh = judged.where("again").select("kind", "plain", (attempt + 1).alias("attempt"))
        if not fresh.limit(1).count():
            return settled.drop("drawn")


def _refitted(text: Column, pattern: Column, made: Column) -> Column:
    """``text`` with the matches of a pattern replaced by the values of ``made``."""
    return F.array_join(F.zip_with(F.split(text, pattern, -1), F.concat(made, F.array(F.lit(""))), lambda a, b: F.concat(a, b)), "")


def _replaced(text: Column, found: Column, again: Column, attempts, key: str) -> Column:
    """``text`` with every entity replaced; ``attempts`` gives the attempt of (kind, plain)."""
    given = F.from_json(F.lit(json.dumps(_given_names(key))), "map<string,string>")

    def word(w: Column) -> Column:
        def own(plain: Column) -> Column:
            made = F.coalesce(F.try_element_at(given, plain), word_surrogate(plain, attempts(F.lit("word"), plain), key))
            return _let(made, lambda x: F.when((F.length(w) > 1) & (w == F.upper(w)), F.upper(x)).otherwise(F.concat(F.upper(F.substring(x, 1, 1)), F.substring(x, F.lit(2), F.length(x)))))

        return F.when(F.lower(w).isin(_KEPT), w).otherwise(_let(F.lower(w), own))

    def one(entity: Column) -> Column:
        def of(kind: Column) -> Column:
            name = _refitted(entity, F.lit(_WORD), F.transform(F.regexp_extract_all(entity, F.lit(_WORD), F.lit(0)), word))
            return F.when(kind == "name", name).when(kind == "none", entity).otherwise(surrogate(kind, entity, attempts(kind, canonical(kind, entity)), key))

        return _let(kind_of(entity, again), of)

    return F.when(F.size(found) > 0, _refitted(text, _pattern(again), F.transform(found, one))).otherwise(text)


def replace_pii(docs: DataFrame, key: str, inline: int = INLINE_REDRAWS, count: str | None = None) -> DataFrame:
    """``docs`` with surrogates in the text column; all other columns stay.

    A column named by ``count`` is added, with the number of entities.
    """
    redrawn = materialize(dictionary(docs, key).where("attempt > 0"), "redraws")
    rows = redrawn.limit(inline + 1).collect()
    marked, found, again = _marked(docs)
    text, zero = F.col("text"), F.lit(0)
    if len(rows) <= inline:
        listed = F.from_json(F.lit(json.dumps({f"{r['kind']}|{r['plain']}": r["attempt"] for r in rows})), "map<string,int>")
        attempts = lambda k, p: F.coalesce(F.try_element_at(listed, F.concat_ws("|", k, p)), zero) if rows else zero
    else:
        # each text's own redraws, joined by the text's hash: bounded by the text
        mark, own = free(marked, "mark"), free(marked, "redrawn")
        marked = marked.withColumn(mark, F.xxhash64(text))
        each = marked.select(mark, F.explode(F.array_distinct(_atoms(found, again))).alias("e")).select(mark, "e.kind", "e.plain").distinct()
        listed = each.join(redrawn, ["kind", "plain"]).groupBy(mark).agg(
            F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "plain"), "attempt"))).alias(own)
        )
        marked = marked.join(listed, mark, "left")
        attempts = lambda k, p: F.coalesce(F.try_element_at(F.col(own), F.concat_ws("|", k, p)), zero)
    counted = [F.size(F.filter(found, lambda e: ~_unchecked(e))).cast("bigint").alias(free(docs, count))] if count else []
    columns = [_replaced(text, found, again, attempts, key).alias("text") if c == "text" else F.col(f"`{c}`") for c in docs.columns]
    return marked.select(*columns, *counted)


def op8_pii(spark, sf_dir: str) -> DataFrame:
    """All documents: text with surrogates, number of entities, whether it changed."""
    made = replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"), key_of(spark), count="n_entities")
    return made.withColumn("changed", F.col("n_entities") > 0)
