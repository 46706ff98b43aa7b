"""Personal data replaced by keyed surrogates of the same type.

Entities are found by one pattern. Their distinct values get surrogates from a keyed
digest; a value whose surrogate is taken, or is itself an original, takes the next
attempt, so different people stay different and one person stays one everywhere. Mentions
keep their own format: a phone number written in two ways gets one new number, written in
those two ways. Only values and positions are shuffled while surrogates are chosen.

A person is found behind a title. The words of those names are the entity table of their
text: the same words without a title are mentions too. A surname alone, with a title or
without, is the person of the text who has it; of several, the one whose neighbouring word
or title's gender fits, else the first. One name is one person everywhere: gender is what
all its titles agree on, and only chooses the first name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitegrain.llm.common import let, lower_ascii, text_key
from sitegrain.plans.staging import Staging

# What counts as an entity, and words that tell a person's gender.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
SECRET = r"\b(?i:password|passwd|secret|token|api[_-]?key)\s{0,2}[=:]\s{0,2}[\"']?(?=[_+/-]*+[A-Za-z0-9])[A-Za-z0-9_+/-]{8,}"
IP = r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9]|\.[0-9])"
CARD = r"(?<![0-9])[0-9]{4}(?:[ -]?[0-9]{4}){3}(?![0-9])"
SSN = r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])"
#: Digits in groups of 3, 3 and 4; a country code and what follows; Germany's and France's numbers with
#: their 0 (no dates); Spain's; ten in a row as North America gives them.
PHONE = (
    r"(?<![0-9])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9])"
    r"|(?<![0-9+])(?:\+|00)[1-9](?:[ ./()-]{0,2}[0-9]){7,14}(?![0-9])"
    r"|(?<![0-9.,/-])0[1-9](?:[ .-]?[0-9]{2}){4}(?![0-9])"
    r"|(?<![0-9.,/-])(?:\(0[1-9][0-9]{1,4}\) ?|0[1-9][0-9]{1,4}[ /-]{1,3})[0-9]{3,8}(?:[ -][0-9]{2,5}){0,3}(?![0-9])"
    r"|(?<![0-9.,/-])(?:[6-9][0-9]{2}(?:[ -][0-9]{3}){2}|[6-9][0-9]{2}(?: [0-9]{2}){3}|9[0-9] [0-9]{3}(?: [0-9]{2}){2})(?![0-9])"
    r"|(?<![0-9.,/-])[2-9][0-9]{2}[2-9][0-9]{6}(?![0-9])"
)
#: A country code by its length: 1 and 7, those of two digits, the rest of three; then a 0 that is not dialled.
_BEFORE_NATIONAL = r"^(?:\+|00)(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})[ ./-]*(?:\(?0\)?)?|^\(?0"
FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Mme", "Madame", "Señora", "Sra", "Г-жа")
MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Г-н")
NEUTRAL = ("Dr", "Prof", "Mx")
_TITLES = "|".join(sorted(FEMALE + MALE + NEUTRAL, key=len, reverse=True))
#: A word with a capital: O'Brien and Smith-Jones are one, the s of Smith's is no part of it.
_CAPITAL = r"\p{Lu}[\p{L}\p{M}]*+(?:(?:['’](?!s(?!\p{L}))|-)\p{L}[\p{L}\p{M}]*+)*+"
_NAME_WORD = rf"(?:\p{{Lu}}\.(?= \p{{Lu}})|{_CAPITAL})"
NAME = rf"(?<![\p{{L}}])(?:{_TITLES})\.? {_NAME_WORD}(?: (?!(?:{_TITLES})(?!\p{{L}})){_NAME_WORD}){{0,2}}"
#: What may be a name's word without a title.
WORD = r"(?<![\p{L}\p{M}0-9_])" + _CAPITAL
ENTITY = "|".join((EMAIL, SECRET, IP, CARD, SSN, PHONE, NAME))

# Parts of invented names, by script.
FIRST = {
    "latin": {
        "f": "Ada Bela Cora Dina Edda Fina Gerda Hanna Ida Jola Kira Lena Mina Nora Olga Petra".split(),
        "m": "Adam Bruno Carlo Dario Emil Felix Georg Hugo Ivo Jonas Karl Leo Max Nils Otto Paul".split(),
    },
    "cyrillic": {
        "f": "Ада Бэла Вера Галя Дина Ева Жанна Зоя Инна Клара Лара Майя Нина Ольга Рита Соня".split(),
        "m": "Адам Борис Вадим Глеб Денис Егор Захар Игорь Кирилл Лев Марк Назар Олег Пётр Роман Семён".split(),
    },
}
SYLLABLES = {
    "latin": "ba de fi go ku la me ni po ru sa te vi wo za lu".split(),
    "cyrillic": "ба де фи го ку ла ме ни по ру са те ви во за лу".split(),
}
_HEX = "0123456789abcdef"

# Fixed value: attempts in the shape of a secret or phone number before its surrogates grow.
SHAPE_ATTEMPTS = 8
#: Up to so many words of names, a text's own words are looked up in the row before they are joined.
NAME_WORDS = 64


def entities(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({ENTITY})"), F.lit(1))


def kind(mention: Column) -> Column:
    """Type of a mention: email, secret, ip, card, ssn, name or phone."""
    full = lambda p: mention.rlike(f"^(?:{p})$")
    return (
        F.when(mention.contains("@"), "email")
        .when(full(SECRET), "secret")
        .when(full(IP), "ip")
        .when(full(CARD), "card")
        .when(full(SSN), "ssn")
        .when(full(NAME), "name")
        .otherwise("phone")
    )


_SECRET_LABEL = r"^(.*?[=:]\s{0,2}[\"']?)([A-Za-z0-9_+/-]+)$"
_NAME_PARTS = r"^([^ ]+ )(.+)$"
_HEXADECIMAL, _UPPER_HEXADECIMAL = "^(?:[0-9a-f]+|[0-9A-F]+)$", "^[0-9A-F]*[A-F][0-9A-F]*$"


def value(mention: Column) -> Column:
    """What two mentions of one entity share, whatever their format."""
    k, secret = kind(mention), F.regexp_extract(mention, _SECRET_LABEL, 2)
    return (
        F.when(k == "email", lower_ascii(mention))
        .when(k == "secret", F.when(secret.rlike(_HEXADECIMAL), lower_ascii(secret)).otherwise(secret))
        .when(k == "name", F.regexp_extract(mention, _NAME_PARTS, 2))
        .when(k == "ip", mention)
        .when(k == "phone", F.regexp_replace(F.regexp_replace(mention, _BEFORE_NATIONAL, ""), "[^0-9]", ""))
        .otherwise(F.regexp_replace(mention, "[^0-9]", ""))
    )


def gender(name: Column) -> Column:
    title = F.regexp_replace(F.regexp_extract(name, _NAME_PARTS, 1), r"[. ]", "")
    return F.when(title.isin(*FEMALE), "f").when(title.isin(*MALE), "m").otherwise("n")


def _pick(options: list[str], digit: Column) -> Column:
    """One of sixteen by a hexadecimal digit."""
    return F.element_at(F.array(*map(F.lit, options)), F.instr(F.lit(_HEX), digit))


def _digits(seed: Column) -> Column:
    return F.translate(seed, "abcdef", "012345")


def _at(seed: Column, i: Column | int) -> Column:
    i = F.lit(i) if isinstance(i, int) else i
    return F.substring(seed, F.pmod(i, F.lit(64)) + 1, F.lit(1))


def _like(shape: Column, seed: Column) -> Column:
    """Letters for letters and digits for digits, the rest as it is."""
    letters = lambda i: F.translate(_at(seed, i), _HEX, "abcdefghijkmnprs")
    return F.array_join(
        F.transform(
            F.split(shape, ""),
            lambda c, i: F.when(c.rlike("[0-9]"), _at(_digits(seed), i)).when(c.rlike("[a-z]"), letters(i)).when(c.rlike("[A-Z]"), F.upper(letters(i))).otherwise(c),
        ),
        "",
    )


def _luhn(digits: Column) -> Column:
    """Fifteen digits and their check digit."""
    total = F.aggregate(
        F.transform(F.split(digits, ""), lambda d, i: let(d.cast("int") * F.when(i % 2 == 0, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v))),
        F.lit(0),
        lambda a, v: a + v,
    )
    return F.concat(digits, F.pmod(10 - total % 10, F.lit(10)).cast("string"))


def _agreed() -> Column:
    """Gender of a group's titles, n for none and for both."""
    some = lambda g: F.coalesce(F.max(F.col("gender") == g), F.lit(False))
    return F.when(some("f") & ~some("m"), "f").when(some("m") & ~some("f"), "m").otherwise("n")


def _name(val: Column, seed: Column) -> Column:
    """A name of the value's gender, script and number of parts."""
    script = F.when(val.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")

    def of(s: str) -> Column:
        female = (F.substring(val, 1, 1) == "f") | ((F.substring(val, 1, 1) == "n") & (_at(seed, 63) >= "8"))
        first = lambda i: F.when(female, _pick(FIRST[s]["f"], _at(seed, i))).otherwise(_pick(FIRST[s]["m"], _at(seed, i)))
        last = F.initcap(F.concat(*[_pick(SYLLABLES[s], _at(seed, i)) for i in range(1, 8)]))
        return F.concat_ws(" ", F.when(val.rlike("^. [^ ]+ "), first(0)), F.when(val.rlike("^. [^ ]+ [^ ]+ "), first(8)), last)

    return F.concat(F.substring(val, 1, 2), F.when(script == "cyrillic", of("cyrillic")).otherwise(of("latin")))


def surrogate_value(k: Column, val: Column, attempt: Column, key: str) -> Column:
    """The value that stands for ``val``: same type and shape, from a keyed digest. Later
    attempts draw from the same space, so a space that is nearly full takes more of them.
    The space of a secret or a short phone number may be smaller than the number of its
    originals: from attempt ``SHAPE_ATTEMPTS`` on, each attempt gives one more character of a
    kind that it has. A name has its gender in front, which only its first names depend on."""
    named = F.when(k == "name", F.substring(val, F.lit(3), F.length(val))).otherwise(val)
    digest = F.sha2(F.concat_ws("\x01", F.lit(key), k, named, attempt.cast("string")), 256)
    more = F.when(val.rlike("[a-z]"), "a").when(val.rlike("[A-Z]"), "A").otherwise("0")
    shape = F.concat(val, F.repeat(more, F.greatest(attempt - SHAPE_ATTEMPTS + 1, F.lit(0)).cast("int")))
    part = lambda s, i, n: F.conv(F.substring(s, i, 6), 16, 10).cast("long") % n

    def phone(seed: Column) -> Column:
        # Ten digits: area and exchange begin with 2 to 9. Nine: the first tells France's regions and Spain's kinds of line.
        digit = lambda i: _at(_digits(seed), i)
        first = lambda i: F.translate(digit(i), "01", "67")
        ten = F.length(val) == 10
        lead = F.when(F.length(val) == 9, F.substring(val, 1, 1)).otherwise(first(0))
        return F.array_join(F.transform(F.split(shape, ""), lambda c, i: F.when(i == 0, lead).when(ten & (i == 3), first(3)).otherwise(digit(i))), "")

    def of(seed: Column) -> Column:
        return (
            F.when(k == "email", F.concat(_like(F.substring_index(val, "@", 1), seed), F.lit("@"), F.translate(F.substring(seed, 33, 10), _HEX, "abcdefghijkmnprs"), F.lit(".example")))
            .when((k == "secret") & val.rlike("^[0-9a-f]+$"), F.array_join(F.transform(F.split(shape, ""), lambda c, i: _at(seed, i)), ""))
            .when(k == "secret", _like(shape, seed))
            .when(k == "ip", F.concat_ws(".", (part(seed, 1, 223) + 1).cast("string"), part(seed, 7, 256).cast("string"), part(seed, 13, 256).cast("string"), (part(seed, 19, 254) + 1).cast("string")))
            .when(k == "card", _luhn(F.concat(F.substring(val, 1, 1), F.substring(_digits(seed), 2, 14))))
            .when(k == "name", _name(val, seed))
            .when(k == "phone", phone(seed))
            .otherwise(_like(val, seed))
        )

    return let(digest, of)


def render(mention: Column, k: Column, val: Column, length: Column, part: Column) -> Column:
    """``val`` written as ``mention`` is, whose own value has ``length`` characters. Digits before
    those of the value (a country code) stay, digits that are more than it had follow the last.
    Of a name, word ``part`` only, or all for null."""
    before = F.length(F.regexp_replace(mention, "[^0-9]", "")) - length
    by_digit = F.aggregate(
        F.split(mention, ""),
        F.struct(F.lit("").alias("s"), F.lit(0).alias("n")),
        lambda a, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(a["s"], F.when(a["n"] < before, c).otherwise(F.substring(val, a["n"] - before + 1, F.lit(1)))).alias("s"), (a["n"] + 1).alias("n"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["n"].alias("n"))
        ),
        lambda a: F.concat(a["s"], F.substring(val, length + 1, F.length(val))),
    )
    secret = F.when(F.regexp_extract(mention, _SECRET_LABEL, 2).rlike(_UPPER_HEXADECIMAL), F.upper(val)).otherwise(val)
    return (
        F.when(k.isin("email", "ip"), val)
        .when(k == "secret", F.concat(F.regexp_extract(mention, _SECRET_LABEL, 1), secret))
        .when(k == "name", F.concat(F.regexp_extract(mention, _NAME_PARTS, 1), F.coalesce(F.get(F.split(val, " "), part), val)))
        .otherwise(by_digit)
    )


def assign(values: DataFrame, stage: Staging, key: str) -> DataFrame:
    """``kind, value, surrogate`` for distinct ``kind, value``, without collisions.

    In each round the first taker of a surrogate (earliest attempt, then smallest value)
    keeps it unless it is an original of the same kind; the others try again."""
    current, step = stage.write(values.withColumn("attempt", F.lit(0)), "values0"), 0
    while True:
        tried = current.withColumn("surrogate", surrogate_value(F.col("kind"), F.col("value"), F.col("attempt"), key))
        # Names carry a title's gender in front; two surrogates must differ in what is written.
        tried = tried.withColumn("written", F.when(F.col("kind") == "name", F.substring("surrogate", 3, 1 << 20)).otherwise(F.col("surrogate")))
        first = tried.groupBy("kind", "written").agg(F.min(F.struct("attempt", "value")).alias("first"))
        originals = values.select("kind", F.when(F.col("kind") == "name", F.substring("value", 3, 1 << 20)).otherwise(F.col("value")).alias("written")).distinct().withColumn("taken", F.lit(True))
        judged = (
            tried.join(first, ["kind", "written"])
            .join(originals, ["kind", "written"], "left")
            .withColumn("again", F.col("taken").isNotNull() | (F.col("first") != F.struct("attempt", "value")))
            .select("kind", "value", "surrogate", "attempt", "again")
        )
        step += 1
        judged = stage.write(judged, f"judged{step}")
        if judged.where("again").isEmpty():
            return judged.select("kind", "value", "surrogate")
        current = judged.select("kind", "value", (F.col("attempt") + F.col("again").cast("int")).alias("attempt"))


def _words(piece: Column) -> Column:
    return F.regexp_extract_all(piece, F.lit(f"({WORD})"), F.lit(1))


def _bare(text: Column, found: Column) -> Column:
    """Words of ``text`` that may belong to a name found in it: ``g`` (place among the words and
    entities), ``pos`` (entities before), ``word`` and its neighbours."""
    names = F.filter(found, lambda m: kind(m) == "name")
    own = F.array_distinct(F.flatten(F.transform(names, lambda m: F.split(F.regexp_extract(m, _NAME_PARTS, 2), " "))))
    units = F.flatten(
        F.transform(
            F.split(text, ENTITY, -1),
            lambda p, i: F.concat(F.transform(_words(p), lambda w: F.struct(i.alias("pos"), w.alias("word"))), F.array(F.struct(i.alias("pos"), F.lit("").alias("word")))),
        )
    )

    def among(own: Column) -> Column:
        near = lambda u: F.transform(
            u, lambda x, g: F.struct(g.alias("g"), x["pos"].alias("pos"), x["word"].alias("word"), F.get(u, g - 1)["word"].alias("before"), F.get(u, g + 1)["word"].alias("after"))
        )
        wanted = lambda x: (F.length(x["word"]) > 1) & ((F.size(own) > NAME_WORDS) | F.array_contains(own, x["word"]))
        return F.when(F.size(own) > 0, F.filter(let(units, near), wanted))

    return let(own, among)


def _resolved(mentions: DataFrame, bare: DataFrame) -> DataFrame:
    """Mentions of names and bare words with the name in their text that they stand for and, if
    they are one word of it, which: ``_k, pos, entity, g, mention, kind, value, length, part``."""
    parts = F.split("value", " ")
    people = mentions.where("kind = 'name'").groupBy("_k", "value").agg(F.min("pos").alias("pos"), _agreed().alias("gender"))
    # A surname of several words' name comes before a name of one word, and that before a first name.
    rank = lambda i: F.when(F.size(parts) == 1, 1).when(i == F.size(parts) - 1, 0).otherwise(2)
    named = people.select("_k", "gender", "value", "pos", F.explode(F.transform(parts, lambda w, i: F.struct(w.alias("word"), i.alias("part"), rank(i).alias("rank")))).alias("w"))
    who = F.struct(F.col("w.rank").alias("rank"), "pos", "value", F.col("w.part").alias("part"))
    of = lambda g: F.min(F.when((F.col("gender") == g) & (F.col("w.rank") == 0), who))
    words = named.groupBy("_k", F.col("w.word").alias("word")).agg(F.min(who).alias("best"), of("f").alias("best_f"), of("m").alias("best_m"), F.count(F.lit(1)).alias("people"))
    pairs = (
        people.where(F.size(parts) > 1)
        .select("_k", "pos", "value", F.posexplode(F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), lambda w, i: F.concat(w, F.lit(" "), F.get(parts, i + 1)))).alias("part", "pair"))
        .groupBy("_k", "pair")
        .agg(F.min(F.struct("pos", "value", "part")).alias("who"))
    )
    single = (F.col("kind") == "name") & ~F.col("value").contains(" ")
    columns = lambda value, part, entity: [
        "_k", "pos", F.lit(entity).alias("entity"), "g", "mention", "kind", value.alias("value"), F.length("mention_value").alias("length"), part.cast("int").alias("part")
    ]
    entity = mentions.withColumns({"g": F.lit(0), "mention_value": F.col("value")})
    whole = entity.where(~single).select(columns(F.col("value"), F.lit(None), 1))
    alone = entity.where(single).withColumnRenamed("value", "word").join(words, ["_k", "word"])
    fits = F.coalesce(F.when(F.col("gender") == "f", F.col("best_f")), F.when(F.col("gender") == "m", F.col("best_m")), F.col("best"))
    alone = alone.withColumn("who", fits).select(columns(F.col("who.value"), F.col("who.part"), 1))
    met = bare.distinct().join(words, ["_k", "word"])
    several = lambda *c: F.when(F.col("people") > 1, F.concat_ws(" ", *c))
    side = lambda name: pairs.select("_k", F.col("pair").alias(f"{name}_pair"), F.col("who").alias(f"{name}_who"))
    met = met.withColumns({"left_pair": several("before", "word"), "right_pair": several("word", "after")})
    met = met.join(side("left"), ["_k", "left_pair"], "left").join(side("right"), ["_k", "right_pair"], "left")
    met = met.withColumns({"mention": F.col("word"), "mention_value": F.col("word"), "kind": F.lit("name")}).select(
        columns(F.coalesce("left_who.value", "right_who.value", "best.value"), F.coalesce(F.col("left_who.part") + 1, F.col("right_who.part"), F.col("best.part")), 0)
    )
    return whole.unionByName(alone).unionByName(met)


def replace_entities(docs: DataFrame, stage: Staging, key: str = "surrogates") -> DataFrame:
    """``docs`` with ``text`` rewritten, plus ``_n_entities`` (long) and ``_kinds`` (types in order).

    Each word of a name without a title counts as an entity. A null text stays null and has no
    entities; an empty text stays empty. Repeated rows are rewritten alike, and any column may
    be null: surrogates depend on values and ``key`` alone, first names on gender too.
    Other columns pass through. Column names that begin with an underscore and a word of this
    module (``_row``, ``_k``, ``_new``, ``_n_entities``, ``_kinds``) are reserved.
    """
    found = stage.write(
        docs.select(text_key("text").alias("_k"), let(entities(F.col("text")), lambda m: F.struct(m.alias("m"), _bare(F.col("text"), m).alias("bare"))).alias("x"))
        .where(F.size("x.m") > 0)
        .select("_k", "x.m", "x.bare"),
        "found",
    )
    mentions = stage.write(
        found.select("_k", F.posexplode("m").alias("pos", "mention"))
        .select("_k", "pos", "mention", kind(F.col("mention")).alias("kind"), value(F.col("mention")).alias("value"))
        .withColumn("gender", F.when(F.col("kind") == "name", gender(F.col("mention")))),
        "mentions",
    )
    values = mentions.groupBy("kind", "value").agg(_agreed().alias("gender"))
    named = F.col("kind") == "name"
    values = values.select("kind", F.when(named, F.concat_ws(" ", "gender", "value")).otherwise(F.col("value")).alias("value"))
    plain = lambda c: F.when(named, F.substring(c, 3, 1 << 20)).otherwise(F.col(c)).alias(c)
    table = assign(values, stage, key).select("kind", plain("value"), plain("surrogate"))
    # Texts that occur more than once have the same mentions: one of each position is enough.
    rendered = render(F.col("mention"), F.col("kind"), F.col("surrogate"), F.col("length"), F.col("part"))
    new = (
        _resolved(mentions, found.select("_k", F.inline("bare")))
        .join(table, ["kind", "value"])
        .select("_k", F.struct("pos", "entity", "g", "kind", rendered.alias("new")).alias("x"))
        .groupBy("_k")
        .agg(F.sort_array(F.collect_set("x")).alias("_new"))
    )
    # Words come before the entity that ends their piece: ``entity`` is 0 for them, and 1.
    joined = docs.withColumn("_k", text_key("text")).join(new, "_k", "left")
    entity, bare = F.filter("_new", lambda x: x["entity"] == 1), F.filter("_new", lambda x: x["entity"] == 0)

    def after(new: Column, i: Column) -> Column:
        return F.coalesce(F.get(new, i)["new"], F.lit(""))

    def rebuilt(pieces: Column, new: Column) -> Column:
        return F.array_join(F.transform(pieces, lambda p, i: F.concat(p, after(new, i))), "")

    def units(pieces: Column, new: Column) -> Column:
        """Words and surrogates of entities, each with the text before it."""
        unit = lambda gap, tok: F.struct(gap.alias("gap"), tok.alias("tok"))
        cut = lambda p, i: let(
            F.split(p, WORD, -1), lambda gaps: F.concat(F.transform(_words(p), lambda w, j: unit(F.get(gaps, j), w)), F.array(unit(F.element_at(gaps, -1), after(new, i))))
        )
        return F.flatten(F.transform(pieces, cut))

    def with_words(u: Column, bare: Column) -> Column:
        def put(whole: Column) -> Column:
            upto = lambda x, j: F.coalesce(F.get(bare, j - 1)["g"] + 1, F.lit(0))
            run = lambda lo, n: F.array_join(F.slice(whole, lo + 1, n), "")
            replaced = F.transform(bare, lambda x, j: F.concat(run(upto(x, j), x["g"] - upto(x, j)), F.get(u, x["g"])["gap"], x["new"]))
            last = F.element_at(bare, -1)["g"] + 1
            return F.concat(F.array_join(replaced, ""), run(last, F.size(whole) - last))

        return let(F.transform(u, lambda x: F.concat(x["gap"], x["tok"])), put)

    def rewritten(pieces: Column) -> Column:
        both = lambda new: F.when(F.size(bare) == 0, rebuilt(pieces, new)).otherwise(let(units(pieces, new), lambda u: let(bare, lambda b: with_words(u, b))))
        return let(entity, both)

    text = F.when(F.col("_new").isNull(), F.col("text")).otherwise(let(F.split("text", ENTITY, -1), rewritten))
    return joined.select(
        *[F.col(f"`{c}`") if c != "text" else text.alias("text") for c in docs.columns],
        F.coalesce(F.size("_new"), F.lit(0)).cast("long").alias("_n_entities"),
        F.coalesce(F.transform("_new", lambda x: x["kind"]), F.array().cast("array<string>")).alias("_kinds"),
    )


def surrogate_report(docs: DataFrame, stage: Staging, key: str = "surrogates") -> DataFrame:
    """Per row ``doc_id, n_entities, kinds`` (comma-joined, in order) and the new ``text``."""
    return replace_entities(docs.select("doc_id", "text"), stage, key).select(
        "doc_id", F.col("_n_entities").alias("n_entities"), F.array_join("_kinds", ",").alias("kinds"), "text"
    )
