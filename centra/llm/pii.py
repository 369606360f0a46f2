"""Personal data and secrets to keyed surrogates, in DataFrame operations only.

Entities are found by one pattern: mail, network (both versions) and account addresses, telephone, card and
social security numbers, secrets, access keys, digests, and names. Each gets a surrogate that a secret key decides: the same entity gets
the same surrogate in every document and every spelling of it (coreference), and the surrogate keeps the
type and the format: digits stay digits, letters letters of the same case, separators and prefixes stay, a
valid card or account number stays valid, hexadecimal stays hexadecimal. A name is found by a title before or, in some scripts, after
it, by "name is" or "name:" before it, or by a listed given name with a family name after it. Surrogate names keep their script, and in
Latin, Cyrillic and Greek given names have an ending for their gender, by the title or the list; later mentions of such a name in the document without its title are
replaced alike. A name goes on through all capitalised words, up to another title; its initials become
letters that stand for nothing. In scripts without capitals it is one word. A secret goes on to the first character that no token has.
Names that none of this announces are not found.

Distinct entities must stay distinct. Surrogates are computed for the table of different entities, those that
meet another's surrogate or a real entity are given a next attempt, and so on until none does. Since
a surrogate is a function of key, entity and attempt, only the few entities with a further attempt
(exceptions) have to be brought to the documents, by a hash of the text: broadcast up to EXCEPTIONS of them, joined beyond.
Where no attempt of ROUNDS is free, as in a format with fewer values than entities, the entity is replaced by a
tag with 96 bits of its digest.

Cases: null texts stay null, with no entities. Entities next to each other and repeated ones are each
replaced. Copies of a document get the same replacements. What a row becomes depends on its text alone, so rows that repeat an id
or have none are like others; an id that is no number is null in the report. Patterns repeat no group without a bound, so
texts may be long. An empty table gives an empty result. Other columns are
kept by `replace`, whatever their names.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from centra.llm.shared import cut

KEY = "change-me"
ROUNDS, EXCEPTIONS = 8, 100_000

#: Titles before names, given names, what announces a name, titles after names, and family names that one follows.
MALE = ["Mr", "Mister", "Sir", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Господин", "Κύριος", "السيد", "श्री"]
FEMALE = ["Mrs", "Ms", "Miss", "Madam", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Doña", "Госпожа", "Κυρία", "السيدة", "श्रीमती"]
NEUTRAL = ["Dr", "Doctor", "Prof", "Professor", "الدكتور", "الأستاذ"]
MALE_NAMES = "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Andrew Peter Paul George Kenneth Steven Edward Brian Ronald Kevin Jason Hans Jürgen Klaus Pierre Jean Jacques José Juan Carlos Luis Иван Сергей Алексей Γιώργος".split()
FEMALE_NAMES = "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Lisa Margaret Sandra Ashley Emily Michelle Anna Maria Laura Julia Jane Helen Ursula Monika Marie Sophie Carmen Ana Isabel Ольга Мария Анна Ελένη".split()
ANNOUNCED = r"[Nn]ame(?: is|:) "
AFTER = r"(?:先生|女士|小姐|さん| ?씨)"
FAMILIES = "王李张刘陈杨黄赵吴周徐孙马朱胡郭何高林罗郑梁谢宋唐许邓冯韩曹曾彭萧蔡潘田董袁于余"
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}@(?:[A-Za-z0-9-]{1,63}\.){1,126}[A-Za-z]{2,24}"
PHONE = r"(?<![\p{L}\d+])(?:\+\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}(?!\d)|(?<![\p{L}\d+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?!\d)|(?<![\p{L}\d.+-])\d{3}([.-])\d{3}\1\d{4}(?![\p{L}\d]|[.-]\d)"
SOCIAL = r"(?<![\p{L}\d.+-])\d{3}-\d{2}-\d{4}(?![\p{L}\d]|[.-]\d)"
CARD = r"(?<![\p{L}\d.-])(?:\d{4}[ -]?\d{4}[ -]?\d{4}[ -]?\d{4}|\d{4}[ -]?\d{6}[ -]?\d{5})(?![\p{L}\d])"
ACCOUNT = r"(?<![\p{L}\d])[A-Z]{2}\d{2} ?[A-Z0-9]{4}(?: ?(?=[A-Z0-9]{0,3}\d)[A-Z0-9]{4}){2,6}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\d])"
ADDRESS = r"(?<![\p{L}\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?![\p{L}\d]|\.\d)"
ADDRESS6 = r"(?<![\p{L}\d:.])(?:(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}|(?:[0-9a-fA-F]{1,4}:){1,6}(?::[0-9a-fA-F]{1,4}){1,6})(?![\p{L}\d:])"
ACCESS = r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])gh[pousr]_[A-Za-z0-9]{36}(?![A-Za-z0-9])"
SECRET = r"(?<![A-Za-z])(?:[Pp]assword|[Pp]asswd|[Pp]wd|[Ss]ecret|[Tt]oken|[Aa]pi[_-]?[Kk]ey|PASSWORD|SECRET|TOKEN) ?[=:] ?[\"']?(?=[A-Za-z0-9+/_~-])[A-Za-z0-9+/_.=~-]{8,}(?<!\.)"
DIGEST = r"(?<![A-Za-z0-9])[0-9a-fA-F]{32,64}(?![A-Za-z0-9])"
#: A part of a name, with hyphens and apostrophes but without what English adds after one. Groups are possessive, as others are matched by recursion.
PART = r"\p{Lu}(?:\p{L}+|(?=['’-]\p{L}))(?:-\p{L}+|['’](?!(?:ll|re|ve)(?!\p{L}))\p{L}{2,})*+"
_longest = lambda words: "|".join(sorted(words, key=len, reverse=True))
TITLE = rf"(?:{_longest(MALE + FEMALE + NEUTRAL)})\.? "
LEAD = rf"(?:{TITLE}|{ANNOUNCED})"
INITIAL = r"\p{Lu}\.?"
_more = rf"(?: (?!{TITLE}\p{{Lu}})(?:{PART}|{INITIAL}(?= \p{{Lu}})))*+"
NAME = "|".join([
    rf"(?<![\p{{L}}\d]){LEAD}(?!{TITLE})(?:(?:{INITIAL} (?=\p{{Lu}}))*+{PART}{_more}|[\p{{Lo}}\p{{M}}]{{2,}})",
    rf"(?<![\p{{L}}\d])(?:{_longest(MALE_NAMES + FEMALE_NAMES)})(?: {INITIAL}(?= \p{{Lu}}))*+ (?!{TITLE}\p{{Lu}}){PART}{_more}",
    rf"[{FAMILIES}]\p{{IsHan}}{{0,2}}?(?:先生|女士|小姐)|(?<!\p{{IsHan}})\p{{IsHan}}{{1,4}}さん|(?<!\p{{IsHangul}})\p{{IsHangul}}{{2,4}} ?씨(?!\p{{IsHangul}})",
])
PATTERN = "|".join([EMAIL, SECRET, ACCESS, DIGEST, PHONE, SOCIAL, CARD, ADDRESS, ADDRESS6, ACCOUNT, NAME])
#: What a text must hold to be searched at all; the look-ahead spares most places the lists of words.
_listed = MALE + FEMALE + NEUTRAL + [f"{n} " for n in MALE_NAMES + FEMALE_NAMES] + ["ame is", "AKIA", "ASIA", "gh[pousr]_"]
HINT = rf"[@=:+(]|[0-9](?:[0-9]{{3}}|\.[0-9])|(?=[{''.join(sorted({t[0] for t in _listed}))}])(?:{_longest(_listed)})|[0-9a-fA-F]{{32}}|先生|女士|小姐|さん|씨"

#: Syllables of surrogate names, a consonant and a vowel each, and the endings of given names.
SYLLABLES = {"latin": ("bdfgklmnprstvzhj", "aeiou", "n", "na"), "cyrillic": ("бвгдзклмнпрстфхж", "аеиоу", "н", "на"), "greek": ("βγδζθκλμνξπρστφχ", "αεηιο", "ς", "να")}
#: Code points whose letters spell surrogate names of the other scripts, as many as the name has.
RANGES = {"Arabic": (0x627, 0x64A), "Hebrew": (0x5D0, 0x5EA), "Devanagari": (0x915, 0x939), "Bengali": (0x995, 0x9B9), "Tamil": (0xB95, 0xBB9), "Telugu": (0xC15, 0xC39), "Thai": (0xE01, 0xE2E), "Armenian": (0x561, 0x586), "Georgian": (0x10D0, 0x10F0), "Hangul": (0xAC00, 0xAE00), "Hiragana": (0x3042, 0x3093), "Katakana": (0x30A2, 0x30F3), "Han": (0x4E00, 0x5000)}


def alphabet(script: str) -> str:
    first, last = RANGES[script]
    return "".join(chr(c) for c in range(first, last + 1) if unicodedata.category(chr(c)).startswith("L"))


def _any(c: Column, words: list[str]) -> Column:
    return c.rlike(rf"^(?:{_longest(words)})\.? ")


def kind(m: Column) -> Column:
    return (
        F.when(m.contains("@"), "email")
        .when(m.rlike(rf"^{LEAD}"), "name")
        .when(m.rlike(r"^(?:AKIA|ASIA|gh[pousr]_)"), "access")
        .when(m.rlike(r"^[A-Za-z_-]+ ?[=:]") & ~m.rlike(rf"^{ADDRESS6}$"), "secret")
        .when(m.rlike(r"^[0-9a-fA-F]{32,64}$"), "digest")
        .when(m.rlike(r"^\d+(?:\.\d+){3}$"), "address")
        .when(m.contains(":"), "address6")
        .when(m.rlike(r"^[+(]|^\d{3}[.-]\d{3}[.-]"), "phone")
        .when(m.rlike(r"^\d{3}-\d{2}-\d{4}$"), "social")
        .when(m.rlike(r"^[A-Z]{2}\d{2}"), "account")
        .when(m.rlike(r"^\d"), "card")
        .otherwise("name")
    )


def _value(m: Column) -> Column:
    """The secret itself, without what names it."""
    return F.regexp_replace(m, r"^[A-Za-z_-]+ ?[=:] ?[\"']?", "")


def _names(m: Column) -> Column:
    """The names without the title or what announces them."""
    return F.split(F.regexp_replace(F.regexp_replace(m, rf"^{LEAD}", ""), rf"{AFTER}$", ""), " ")


def _whole(parts: Column) -> Column:
    """Without initials, which are no entities."""
    return F.filter(parts, lambda p: ~p.rlike(rf"^{INITIAL}$"))


def entities(m: Column, of: Column) -> Column:
    """What a match stands for: its spelling made uniform; a name is one entity for each of its parts."""
    return (
        F.when(of == "name", F.transform(_whole(_names(m)), lambda p: F.lower(p)))
        .when(of.isin("email", "address6"), F.array(F.lower(m)))
        .when(of.isin("phone", "card", "social"), F.array(F.regexp_replace(m, "[^0-9]", "")))
        .when(of == "account", F.array(F.replace(m, F.lit(" "), F.lit(""))))
        .when(of == "secret", F.array(_value(m)))
        .otherwise(F.array(m))
    )


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """The body with the value computed once: an expression that it uses several times would otherwise be copied each time."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


class Surrogates:
    """Surrogate expressions under one key."""

    def __init__(self, key: str) -> None:
        self.key = key

    def _stream(self, of: Column, entity: Column, attempt: Column) -> Column:
        """128 hexadecimal digits."""
        inner = F.sha2(F.concat_ws("\x01", F.lit(self.key), of, entity, attempt.cast("string")), 512)
        return F.sha2(F.concat_ws("\x01", F.lit(self.key), inner), 512)

    @staticmethod
    def _number(stream: Column, i: Column) -> Column:
        """A number under 65536 for place i, which is under 32."""
        return F.conv(F.substr(stream, 4 * i + 1, F.lit(4)), 16, 10).cast("int")

    def _scramble(self, s: Column, stream: Column, hexadecimal: bool = False) -> Column:
        """Digits to digits, letters to letters of their case; the rest stays. Every 32 characters have a stream of their own."""

        def piece(p: Column, block: Column, capitals: Column) -> Column:
            def of(own: Column) -> Column:
                def one(i: Column) -> Column:
                    c, n = F.substr(p, i + 1, F.lit(1)), self._number(own, i)
                    if hexadecimal:
                        digit = F.substr(F.lit("0123456789abcdef"), F.pmod(n, F.lit(16)) + 1, F.lit(1))
                        return F.when(~c.rlike("[0-9a-fA-F]"), c).when(capitals, F.upper(digit)).otherwise(digit)
                    letter = F.char(F.lit(97) + F.pmod(n, F.lit(26)))
                    return F.when(c.rlike("[0-9]"), F.pmod(n, F.lit(10)).cast("string")).when(c.rlike("[a-z]"), letter).when(c.rlike("[A-Z]"), F.upper(letter)).otherwise(c)

                return F.array_join(F.transform(F.sequence(F.lit(0), F.length(p) - 1), one), "")

            return let(F.sha2(F.concat_ws("\x01", F.lit(self.key), stream, block.cast("string")), 512), of)

        pieces = F.regexp_extract_all(s, F.lit("(?s).{1,32}"), F.lit(0))
        return let(s == F.upper(s), lambda capitals: F.array_join(F.transform(pieces, lambda p, b: piece(p, b, capitals)), ""))

    def _digits(self, m: Column, stream: Column, keep: Column, check: bool) -> Column:
        """The digits of m replaced in its format but for the first `keep`; if `check`, a number that passes the card checksum still does."""
        plain = F.regexp_replace(m, "[^0-9]", "")
        n = F.length(plain)
        drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.when(i < keep, F.substr(plain, i + 1, F.lit(1)).cast("int")).otherwise(F.pmod(self._number(stream, i), F.lit(10))))

        def luhn(digits: Column) -> Column:
            doubled = F.transform(digits, lambda d, i: F.when(F.pmod(F.size(digits) - i, F.lit(2)) == 0, F.pmod(2 * d, F.lit(10)) + F.floor(2 * d / 10).cast("int")).otherwise(d))
            return F.pmod(F.aggregate(doubled, F.lit(0), lambda a, d: a + d), F.lit(10))

        def checked(digits: Column) -> Column:
            old = F.transform(F.split(plain, ""), lambda d: d.cast("int"))
            valid = let(F.slice(digits, F.lit(1), F.size(digits) - 1), lambda rest: F.concat(rest, F.array(F.pmod(10 - let(F.concat(rest, F.array(F.lit(0))), luhn), F.lit(10)))))
            return F.when(let(old, luhn) == 0, valid).otherwise(digits)

        def spelled(digits: Column) -> Column:
            place = lambda i: F.length(F.regexp_replace(F.substr(m, F.lit(1), i), "[^0-9]", ""))
            out = F.transform(F.sequence(F.lit(1), F.length(m)), lambda i: F.when(F.substr(m, i, F.lit(1)).rlike("[0-9]"), F.get(digits, place(i) - 1).cast("string")).otherwise(F.substr(m, i, F.lit(1))))
            return F.array_join(out, "")

        return let(let(drawn, checked) if check else drawn, spelled)

    @staticmethod
    def _account(m: Column) -> Column:
        """An account number with the check digits that make it valid."""
        values = lambda text: F.transform(F.split(text, ""), lambda c: F.conv(c, 36, 10).cast("int"))
        rest = lambda text: F.aggregate(values(text), F.lit(0), lambda r, v: F.pmod(r * F.when(v < 10, 10).otherwise(100) + v, F.lit(97)))
        plain = F.replace(m, F.lit(" "), F.lit(""))
        check = F.lit(98) - rest(F.concat(F.substr(plain, F.lit(5), F.length(plain)), F.substr(plain, F.lit(1), F.lit(2)), F.lit("00")))
        return F.concat(F.substr(m, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), F.substr(m, F.lit(5), F.length(m)))

    def name(self, part: Column, attempt: Column, gender: Column) -> Column:
        """A name of the part's script and capitals; gender is 'm' or 'f' for a given name, '' for others."""

        def spelled(script: str, stream: Column) -> Column:
            consonants, vowels, male, female = SYLLABLES[script]
            pick = lambda letters, i: F.substr(F.lit(letters), F.pmod(self._number(stream, F.lit(i)), F.lit(len(letters))) + 1, F.lit(1))
            body = F.concat(*[pick(x, 2 * i + j) for i in range(3) for j, x in enumerate((consonants, vowels))])
            return F.concat(body, F.when(gender == "m", male).when(gender == "f", female).otherwise(""))

        def lettered(stream: Column) -> Column:
            letters = F.when(part.rlike(rf"\p{{Is{next(iter(RANGES))}}}"), alphabet(next(iter(RANGES))))
            for script in list(RANGES)[1:]:
                letters = letters.when(part.rlike(rf"\p{{Is{script}}}"), alphabet(script))
            one = lambda own, i: F.substr(own, F.pmod(self._number(stream, F.pmod(i, F.lit(32))), F.length(own)) + 1, F.lit(1))
            return let(letters, lambda own: F.array_join(F.transform(F.sequence(F.lit(0), F.length(part) - 1), lambda i: one(own, i)), ""))

        def word(stream: Column) -> Column:
            known = F.when(part.rlike(r"\p{IsCyrillic}"), spelled("cyrillic", stream)).when(part.rlike(r"\p{IsGreek}"), spelled("greek", stream)).when(part.rlike(r"\p{IsLatin}"), spelled("latin", stream))
            return known.otherwise(F.coalesce(lettered(stream), spelled("latin", stream)))

        cased = lambda w: F.when((part == F.upper(part)) & (part != F.lower(part)) & (F.length(part) > 1), F.upper(w)).when(part == F.lower(part), w).otherwise(F.initcap(w))
        drawn = let(let(self._stream(F.lit("name"), F.lower(part), attempt), word), cased)
        return F.when(attempt >= ROUNDS, self._tag(F.lit("name"), F.lower(part))).otherwise(drawn)

    def of(self, m: Column, of: Column, entity: Column, attempt: Column) -> Column:
        """The surrogate of a match that is no name."""

        def found(s: Column) -> Column:
            octets = F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (F.pmod(self._number(s, i), F.lit(254)) + 1).cast("string"))
            secret = let(_value(m), lambda v: F.concat(F.substr(m, F.lit(1), F.length(m) - F.length(v)), F.when(v.rlike("^[0-9a-fA-F]+$"), self._scramble(v, s, True)).otherwise(self._scramble(v, s))))
            return (
                F.when(of == "email", let(F.substring_index(m, ".", -1), lambda end: F.concat(self._scramble(F.substr(m, F.lit(1), F.length(m) - F.length(end)), s), end)))
                .when(of.isin("phone", "social"), self._digits(m, s, F.when(m.startswith("+"), 1).otherwise(0), False))
                .when(of == "card", self._digits(m, s, F.lit(1), True))
                .when(of == "address", F.array_join(octets, "."))
                .when(of == "access", F.concat(F.substr(m, F.lit(1), F.lit(4)), self._scramble(F.substr(m, F.lit(5), F.length(m)), s)))
                .when(of.isin("digest", "address6"), self._scramble(m, s, True))
                .when(of == "account", let(F.concat(F.substr(m, F.lit(1), F.lit(4)), self._scramble(F.substr(m, F.lit(5), F.length(m)), s)), self._account))
                .otherwise(secret)
            )

        return F.when(attempt >= ROUNDS, self._tag(of, entity)).otherwise(let(self._stream(of, entity, attempt), found))

    def _tag(self, of: Column, entity: Column) -> Column:
        return F.concat(F.lit("["), F.upper(of), F.lit("-"), F.substr(self._stream(of, entity, F.lit(-1)), F.lit(1), F.lit(24)), F.lit("]"))

    def uniform(self, of: Column, entity: Column, attempt: Column) -> Column:
        """The surrogate of an entity in its uniform spelling, which tells whether two can be told apart."""
        alone = F.when(of == "secret", F.concat(F.lit("token="), entity)).otherwise(entity)
        other = let(let(alone, lambda m: self.of(m, of, entity, attempt)), lambda got: F.when(of == "secret", _value(got)).otherwise(got))
        return F.when(of == "name", F.lower(self.name(entity, attempt, F.lit("")))).otherwise(other)


def _matches(text: str) -> Column:
    none = F.array().cast("array<string>")
    return F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(PATTERN), F.lit(0))).otherwise(none)


def exceptions(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """kind_, entity_, attempt_ of the entities whose first surrogate was another's or a real entity."""
    surrogates = Surrogates(key)
    m = F.col("m_")
    found = docs.select(F.explode(_matches(text)).alias("m_")).select("m_", kind(m).alias("kind_"))
    table = cut(found.select("kind_", F.explode(entities(m, F.col("kind_"))).alias("entity_")).distinct().withColumn("attempt_", F.lit(0)))
    real = table.select(F.col("kind_").alias("k_"), F.col("entity_").alias("e_"))
    for last in [False] * ROUNDS + [True]:
        named = table.withColumn("surrogate_", surrogates.uniform(F.col("kind_"), F.col("entity_"), F.col("attempt_")))
        # Of entities that share a surrogate the one with the fewest attempts left to lose, then the first, keeps it.
        shared = named.groupBy("kind_", "surrogate_").agg(F.count("*").alias("n_"), F.min(F.struct(-F.col("attempt_"), "entity_"))["entity_"].alias("first_")).where("n_ > 1")
        taken = named.join(shared.select(F.col("kind_").alias("k_"), F.col("surrogate_").alias("s_"), "first_"), (F.col("kind_") == F.col("k_")) & (F.col("surrogate_") == F.col("s_"))).where("entity_ <> first_").select("kind_", "entity_")
        is_real = named.join(real, (F.col("kind_") == F.col("k_")) & (F.col("surrogate_") == F.col("e_")), "left_semi").select("kind_", "entity_")
        bad = cut(taken.unionAll(is_real).distinct().select(F.col("kind_").alias("bk_"), F.col("entity_").alias("be_")))
        if bad.isEmpty():
            break
        again = table.join(bad, (F.col("kind_") == F.col("bk_")) & (F.col("entity_") == F.col("be_")), "left")
        table = cut(again.select("kind_", "entity_", F.when(F.col("be_").isNull(), F.col("attempt_")).otherwise(F.lit(ROUNDS) if last else F.least(F.col("attempt_") + 1, F.lit(ROUNDS - 1))).alias("attempt_")))
    return table.where("attempt_ > 0")


def replace(docs: DataFrame, key: str = KEY, text: str = "text", counted: str | None = None) -> DataFrame:
    """The documents with surrogates in their texts; `counted`, if named, gets the number of matches."""
    surrogates = Surrogates(key)
    names = docs.columns
    rare = cut(exceptions(docs, key, text))
    n_rare = rare.count()
    # The uniform name of an entity within a text: its type and spelling.
    call = lambda of, entity: F.concat(of, F.lit(":"), entity)
    base = docs.select("*", _matches(text).alias("m__"))
    if n_rare:
        # An entity's attempt is the same everywhere, so texts with one hash may share their entries.
        own = base.select(F.xxhash64(text).alias("row__"), F.explode("m__").alias("m_")).select("row__", "m_", kind(F.col("m_")).alias("kind_"))
        own = own.select("row__", "kind_", F.explode(entities(F.col("m_"), F.col("kind_"))).alias("entity_")).distinct()
        lookup = rare.select(F.col("kind_").alias("rk_"), F.col("entity_").alias("re_"), "attempt_")
        hit = own.join(F.broadcast(lookup) if n_rare <= EXCEPTIONS else lookup, (F.col("kind_") == F.col("rk_")) & (F.col("entity_") == F.col("re_")))
        attempts = hit.groupBy("row__").agg(F.map_from_entries(F.collect_list(F.struct(call(F.col("kind_"), F.col("entity_")), "attempt_"))).alias("attempts__"))
        attempts = cut(attempts)
        few = attempts.count() <= EXCEPTIONS
        base = base.join(F.broadcast(attempts) if few else attempts, F.xxhash64(text) == F.col("row__"), "left").drop("row__")
    else:
        base = base.withColumn("attempts__", F.lit(None).cast("map<string,int>"))
    attempt = lambda of, entity: F.coalesce(F.try_element_at(F.col("attempts__"), call(of, entity)), F.lit(0))

    def one(m: Column) -> Column:
        def titled(parts: Column) -> Column:
            gender = F.when(_any(m, MALE), "m").when(_any(m, FEMALE), "f").when(F.get(parts, F.lit(0)).isin(MALE_NAMES), "m").when(F.get(parts, F.lit(0)).isin(FEMALE_NAMES), "f").otherwise("")
            spelled = lambda p, i: surrogates.name(p, attempt(F.lit("name"), F.lower(p)), F.when(i < F.size(parts) - 1, gender).otherwise(""))
            given = F.transform(parts, lambda p, i: let(spelled(p, i), lambda s: F.when(p.rlike(rf"^{INITIAL}$"), F.concat(F.upper(F.substr(s, F.lit(1), F.lit(1))), F.substr(p, F.lit(2), F.length(p)))).otherwise(s)))
            return F.concat(F.regexp_extract(m, rf"^{LEAD}", 0), F.array_join(given, " "), F.regexp_extract(m, rf"{AFTER}$", 0))

        other = lambda of: let(F.get(entities(m, of), F.lit(0)), lambda e: let(attempt(of, e), lambda a: surrogates.of(m, of, e, a)))
        return let(kind(m), lambda of: F.when(of == "name", let(_names(m), titled)).otherwise(other(of)))

    # Names with a title, for their later mentions without one; the family name is the last.
    known = F.array_distinct(F.flatten(F.transform(F.filter(F.col("m__"), lambda m: kind(m) == "name"), lambda m: _whole(_names(m)))))
    base = base.select("*", known.alias("known__"))
    mention = lambda piece: F.aggregate(
        F.col("known__"), piece, lambda t, p: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\d])"), p, F.lit(r"(?![\p{L}\d])")), surrogates.name(p, attempt(F.lit("name"), F.lower(p)), F.lit("")))
    )
    pieces = F.split(F.col(text), PATTERN, -1)
    plain = F.when(F.size("known__") > 0, F.transform(pieces, mention)).otherwise(pieces)
    woven = F.array_join(F.flatten(F.transform(F.arrays_zip(plain.alias("p"), F.transform(F.col("m__"), one).alias("s")), lambda x: F.array(x["p"], F.coalesce(x["s"], F.lit(""))))), "")
    out = F.when(F.size("m__") > 0, woven).otherwise(F.col(text))
    extra = [F.greatest(F.size("m__"), F.lit(0)).cast("bigint").alias(counted)] if counted else []
    return base.select(*[out.alias(c) if c == text else F.col(c) for c in names], *extra)


def report(docs: DataFrame, key: str = KEY) -> DataFrame:
    """doc_id, n_entities, text."""
    chosen = docs.select(F.expr("try_cast(doc_id AS bigint)").alias("doc_id"), "text")
    return replace(chosen, key, counted="n_entities").select("doc_id", "n_entities", "text")
