"""Personal data replaced by keyed surrogates of the same type, script and format, distinct and the same at each mention."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, group_map, map_bits, map_place, table, with_flag, written

# Patterns in order of precedence. Each starts where nothing that it could begin with stands before,
# and repeats possessively, so that long runs are read once.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@(?:[A-Za-z0-9-]++\.)+[A-Za-z]{2,24}(?![A-Za-z0-9])"
NAMING = r"""(?i:token|secret|password|passwd|api[_-]?key)["']?\s{0,2}[=:]\s{0,2}["']?"""
SECRET = NAMING + r"(?:[A-Za-z0-9_+/=.-]{12,}+|(?=[A-Za-z_+/=.!@#$%^&*-]*+[0-9])[A-Za-z0-9_+/=.!@#$%^&*-]{5,}+)"
#: Access keys that are known by how they begin, which stays.
KEY_PREFIX = r"(?:AKIA|ASIA|gh[pousr]_|xox[abprs]-|sk_live_|rk_live_)"
ACCESS_KEY = rf"(?<![A-Za-z0-9_]){KEY_PREFIX}[A-Za-z0-9-]{{12,}}+(?![A-Za-z0-9_])"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
PHONE = "|".join(
    (
        r"(?<![\w+])\+?\d{1,3}[ .-]?\(\d{2,4}\)[ .-]?\d{3}[ .-]?\d{3,4}(?!\d)",
        r"(?<![\w+])\+(?=(?:[ .-]?\d){7})\d{1,3}(?:[ .-]?\d{1,4}){2,7}+(?!\d)",
        r"(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){2,4}+(?!\d)",
        r"(?<![\w.-])(?:\(\d{3}\)[ .-]?|\(?\d{3}\)?[ .-])\d{3}[ .-]\d{4}(?!\d)",
        r"(?<![\w.-])0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}(?![\d-])",
    )
)
CARD = r"(?<!\d)(?:\d{4}[ -]?){3}\d{4}(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
IP = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d.])"
GROUPS = r"[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,6}+"
IPV6 = rf"(?<![\w:.])(?=[A-Fa-f:]{{0,38}}\d)(?:(?:[0-9A-Fa-f]{{1,4}}:){{7}}[0-9A-Fa-f]{{1,4}}|(?:{GROUPS})?::(?:{GROUPS})?)(?![\w:]|\.\d)"
FEMALE = r"(?:Mrs|Ms|Miss|Frau|Madame|Mme|Mlle|Señora|Sra|Srta|Signora|Г-жа|Госпожа|Κυρία)"
MALE = r"(?:Mr|Herrn|Herr|Monsieur|Señor|Sr|Signor|Г-н|Господин|Κύριος)"
NEUTRAL = r"(?:Dr|Doctor|Doktor|Professor|Prof|Д-р|Профессор|Δρ)"
TITLE = rf"(?:(?:{FEMALE}|{MALE}|{NEUTRAL})\.? ){{1,4}}+"
#: Parts of a name: words without a possessive ending, initials, and particles, which stay. The last part is a word.
WORD = r"\p{Lu}(?=[\p{L}'’-])\p{L}*+(?:['’-](?!s(?!\p{L}))\p{L}++)*+"
INITIAL = r"(?:\p{Lu}\.-?){1,4}+"
PARTICLE = r"(?:van|von|vom|zu|zur|der|den|ter|ten|de|del|della|di|da|do|dos|das|du|la|le|bin|ibn|al|el)"
NAME = rf"(?<![\p{{L}}\p{{N}}]){TITLE}(?:(?:{INITIAL}|{WORD}|{PARTICLE}) ){{0,9}}{WORD}"
#: What a text has at least if one of the patterns matches: it keeps the search away from most texts.
SIGNS = r"[@0-9]|AKIA|ASIA|gh[pousr]_|xox[abprs]-|(?i:token|secret|password|passwd|api.?key)"
TITLES = [x.strip("()?:") for x in f"{FEMALE}|{MALE}|{NEUTRAL}".replace("(?:", "").replace(")", "").split("|")]
ANY = "|".join(f"(?:{x})" for x in (EMAIL, SECRET, ACCESS_KEY, IBAN, PHONE, CARD, SSN, IP, IPV6, NAME))
# Syllables of names by script, and endings of given names for women and men.
SYLLABLES = {
    "latin": "ba be bi bo da de di do fa fe ga ha jo ka ke ki la le li lo ma me mi mo na ne ni no ra re ri ro sa se si so ta te ti to va ve vi wa we yo za zo".split(),
    "cyrillic": "ба бе бо ва ве ви га го да де до жа за зо ка ки ко ла ле ли ма ми мо на ни но па по ра ре ро са си со та ти то фа хо ча ша".split(),
    "greek": "βα βε γα γο δα δη δι θα θε κα κο λα λε λι μα με μι να νι νο πα πε πο ρα ρη ρο σα σε σι τα τε τι φα φι χα".split(),
}
ENDINGS = {"latin": ("na", "rin"), "cyrillic": ("на", "рин"), "greek": ("να", "νος")}
SCRIPTS = {"cyrillic": r"\p{IsCyrillic}", "greek": r"\p{IsGreek}"}
DIGITS, NAMES = ("phone", "card", "ssn"), ("given-f", "given-m", "given", "family")
#: Capital letters by script: an initial becomes another one.
CAPITALS = {"latin": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "cyrillic": "АБВГДЕЖЗИКЛМНОПРСТУФХЧШЭЮЯ", "greek": "ΑΒΓΔΕΖΗΘΙΚΛΜΝΞΟΠΡΣΤΥΦΧΨΩ"}


def _kind(match: Column) -> Column:
    return (
        F.when(F.contains(match, F.lit("@")), "email")
        .when(match.rlike(rf"^{TITLE}"), "name")
        .when(match.rlike(rf"^{NAMING}"), "secret")
        .when(match.rlike(rf"^{ACCESS_KEY}$"), "key")
        .when(match.rlike(rf"^(?:{SSN})$"), "ssn")
        .when(match.rlike(r"^(?:\d{1,3}\.){3}\d{1,3}$"), "ip")
        .when(match.rlike(r"^[0-9A-Fa-f:]*:[0-9A-Fa-f:]*$"), "ipv6")
        .when(match.rlike(r"^(?:\d{4}[ -]?){3}\d{4}$"), "card")
        .when(match.rlike(r"^[\d+(][\d ().-]+$"), "phone")
        .when(match.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?$"), "iban")
        .otherwise("phone")
    )


def _let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed, and written into the plan, once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _entity(kind: Column | str, norm: Column) -> Column:
    return F.struct((F.lit(kind) if isinstance(kind, str) else kind).alias("kind"), norm.alias("norm"))


def _name_parts(match: Column) -> Column:
    gendered = lambda titles: match.rlike(rf"^(?:{NEUTRAL}\.? )*{titles}\.? ")
    given = F.when(gendered(FEMALE), "given-f").when(gendered(MALE), "given-m").otherwise("given")

    def parts(words: Column) -> Column:
        kind = lambda w, i: F.when(w.rlike(rf"^{INITIAL}$"), "initial").when(w.rlike(rf"^{PARTICLE}$"), "particle").when(i == F.size(words) - 1, "family").otherwise(given)
        return F.transform(words, lambda w, i: _entity(kind(w, i), w))

    return _let(F.split(F.regexp_replace(match, rf"^{TITLE}", ""), " "), parts)


def mention(match: Column) -> Column:
    """(raw, kind, entities) of a match. Each entity has the form that all its mentions share; a name has one for each part."""

    def of(kind: Column) -> Column:
        norm = F.when(kind.isin("email", "ipv6"), F.lower(match)).when(kind.isin(*DIGITS), F.regexp_replace(match, r"\D", "")).when(kind == "iban", F.replace(match, F.lit(" "), F.lit(""))).when(kind == "secret", F.regexp_replace(match, rf"^{NAMING}", "")).otherwise(match)
        return F.struct(match.alias("raw"), kind.alias("kind"), F.when(kind == "name", _name_parts(match)).otherwise(F.array(_entity(kind, norm))).alias("entities"))

    return _let(_kind(match), of)


def matches(text: Column) -> Column:
    """The mentions in a text, in order."""
    signs = text.rlike(SIGNS)
    for title in TITLES:
        signs = signs | F.contains(text, F.lit(title))
    found = F.when(text.isNull(), F.lit(None)).when(signs, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))
    return F.transform(found, mention)


def _luhn(digits: Column) -> Column:
    """The digit that completes 15 digits to a valid card number."""
    total = F.lit(0)
    for i in range(15):
        d = F.substring(digits, i + 1, 1).cast("int") * (2 if i % 2 == 0 else 1)
        total = total + F.when(d > 9, d - 9).otherwise(d)
    return ((10 - total % 10) % 10).cast("string")


def surrogate(kind: Column, norm: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of an entity's norm at an attempt.

    Digits stay digits, letters letters of their case, hexadecimal strings hexadecimal; an email keeps its top-level
    domain, an IBAN its country, a phone number its first digit; addresses stay in range and card numbers valid. Names
    are made of syllables of their script, one more at each attempt, and given names end as their gender does.
    """
    pick = lambda text, n: F.substring(F.lit(text), (n % len(text) + 1).cast("int"), F.lit(1))
    number = lambda stream, i: F.conv(F.substring(stream, (i * 2) % 126 + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 63).cast("int")

    def shaped(c: Column, n: Column) -> Column:
        return F.when(c.rlike("^[0-9]$"), pick("0123456789", n)).when(c.rlike("^[a-z]$"), pick("abcdefghijklmnopqrstuvwxyz", n)).when(c.rlike("^[A-Z]$"), pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).otherwise(c)

    def name(script: str, stream: Column) -> Column:
        syllables = F.array(*map(F.lit, SYLLABLES[script]))
        part = F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), lambda i: F.get(syllables, number(stream, i) % len(SYLLABLES[script]))), "")
        woman, man = ENDINGS[script]
        return F.initcap(F.concat(part, F.when(kind == "given-f", woman).when(kind == "given-m", man).otherwise("")))

    def like_norm(stream: Column) -> Column:
        chars = F.split(norm, "")
        return F.when(norm.rlike("^[0-9a-f]+$"), F.array_join(F.transform(chars, lambda c, i: pick("0123456789abcdef", number(stream, i))), "")).otherwise(F.array_join(F.transform(chars, lambda c, i: shaped(c, number(stream, i))), ""))

    def finished(shape: Column, stream: Column) -> Column:
        top = F.length(F.regexp_extract(norm, r"\.[a-z0-9-]*$", 0))
        return (
            F.when(kind == "email", F.concat(F.substring(shape, F.lit(1), F.length(norm) - top), F.substring(norm, F.length(norm) - top + 1, top)))
            .when(kind == "ip", F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (number(stream, i) % 254 + 1).cast("string")), "."))
            .when(kind == "ipv6", F.array_join(F.transform(F.split(norm, ""), lambda c, i: F.when(c == ":", c).otherwise(pick("0123456789abcdef", number(stream, i)))), ""))
            .when(kind == "card", F.concat(F.substring(shape, 1, 15), _luhn(F.substring(shape, 1, 15))))
            .when(kind == "key", _let(F.length(F.regexp_extract(norm, rf"^{KEY_PREFIX}", 0)), lambda n: F.concat(F.substring(norm, F.lit(1), n), F.substring(shape, n + 1, F.length(norm)))))
            .when(kind == "phone", F.concat(F.substring(norm, 1, 1), F.substring(shape, F.lit(2), F.length(norm))))
            .when(kind == "iban", F.concat(F.substring(norm, 1, 2), F.substring(shape, F.lit(3), F.length(norm))))
            .otherwise(shape)
        )

    def made(stream: Column) -> Column:
        digits = F.array_join(F.transform(F.split(norm, ""), lambda c, i: pick("0123456789", number(stream, i))), "")
        names = F.when(norm.rlike(SCRIPTS["cyrillic"]), name("cyrillic", stream)).when(norm.rlike(SCRIPTS["greek"]), name("greek", stream)).otherwise(name("latin", stream))
        shape = F.when(kind.isin(*DIGITS), digits).otherwise(like_norm(stream))
        other = _let(shape, lambda x: finished(x, stream))
        # A form with too few values for all entities gets more characters in the end.
        other = F.when(attempt > 12, F.concat(other, F.lit("0"), attempt.cast("string"))).otherwise(other)
        return F.when(kind.isin(*NAMES), names).otherwise(other)

    seed = F.concat_ws("|", F.lit(key), kind, norm, attempt.cast("string"))
    return _let(F.concat(F.sha2(seed, 256), F.sha2(F.concat(seed, F.lit("|2")), 256)), made)


def other_initials(initials: Column, key: str) -> Column:
    """Initials with other letters of their script, each the same at all mentions; too few to be told apart."""

    def other(c: Column) -> Column:
        n = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{key}|initial|"), c), 256), 1, 6), 16, 10).cast("int")
        of = lambda script: F.substring(F.replace(F.lit(CAPITALS[script]), c, F.lit("")), n % (len(CAPITALS[script]) - 1) + 1, F.lit(1))
        return F.when(c.isin(".", "-", ""), c).when(c.rlike(SCRIPTS["cyrillic"]), of("cyrillic")).when(c.rlike(SCRIPTS["greek"]), of("greek")).otherwise(of("latin"))

    return F.array_join(F.transform(F.split(initials, ""), other), "")


def _with_known(piece: Column, known: Column) -> Column:
    """piece with each word that is the old form of one of known, an array of (old, new), replaced by the new one in one pass."""
    words = F.concat(F.lit(r"(?<![\p{L}\p{N}])(?:"), F.array_join(F.transform(known, lambda x: x["old"]), "|"), F.lit(r")(?![\p{L}\p{N}])"))
    put = lambda old: F.get(F.filter(known, lambda x: x["old"] == old), F.lit(0))["new"]
    news = F.concat(F.transform(F.regexp_extract_all(piece, words, F.lit(0)), put), F.array(F.lit("")))
    return F.array_join(F.zip_with(F.split(piece, words, -1), news, lambda p, n: F.concat(p, n)), "")


def _filled(raw: Column, made: Column) -> Column:
    """raw with its letters and digits replaced by made's, in order; what made has more comes last."""
    start = F.struct(F.lit(1).alias("i"), F.lit("").alias("out"))
    step = lambda acc, c: F.when(c.rlike("^[A-Za-z0-9]$"), F.struct((acc["i"] + 1).alias("i"), F.concat(acc["out"], F.substring(made, acc["i"], F.lit(1))).alias("out"))).otherwise(F.struct(acc["i"].alias("i"), F.concat(acc["out"], c).alias("out")))
    done = F.aggregate(F.split(raw, ""), start, step)
    return _let(done, lambda d: F.concat(d["out"], F.substring(made, d["i"], F.length(made))))


def attempts(found: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) of the entities whose first surrogate is no good, with the attempt that is.

    A surrogate is good if no other entity of its kind has it as its own name or as its surrogate. Of entities that
    want one surrogate the least gets it, the others try again; each round is over what the last one left.
    """
    known = written(found.select("kind", "norm").distinct(), "entities")
    pending, taken, n = known, None, 0
    while True:
        wanted = written(pending.withColumn("made", surrogate(F.col("kind"), F.col("norm"), F.lit(n), key)), "wanted")
        good = wanted.join(known.select("kind", F.col("norm").alias("made")), ["kind", "made"], "left_anti")
        if taken is not None:
            good = good.join(taken.select("kind", "made"), ["kind", "made"], "left_anti")
        good = written(good.groupBy("kind", "made").agg(F.min("norm").alias("norm")).withColumn("attempt", F.lit(n)), "good")
        taken = good if taken is None else taken.unionByName(good)
        pending = wanted.join(good, ["kind", "norm"], "left_anti").select("kind", "norm")
        n += 1
        if pending.isEmpty():
            return taken.filter("attempt > 0").select("kind", "norm", "attempt")


def with_surrogates(docs: DataFrame, key: str = "surrogates", text_col: str = "text", id_col: str = "doc_id") -> DataFrame:
    """docs with surrogates in the text, and with n_entities and entity_kinds (sorted, comma-joined).

    Entities: email addresses, secrets after a naming word, access keys of known forms, IBANs, phone, card and social security numbers, IPv4 and
    IPv6 addresses, and names of up to ten parts after a title, of which the last is the family name; each word of such
    a name is replaced wherever it stands as a word in the same text, with a title or without. Initials become others,
    particles stay.
    The same entity gets the same surrogate in all texts and at all mentions, different ones different surrogates.
    Surrogates are computed where the text is; only texts with an entity that needed a further attempt, known from a
    map of fixed size, are joined with the list of those.

    Null text stays null and has no entities; texts without entities stay as they are; repeated rows get equal
    results; an empty table gives no rows. Columns of docs that have one of the two names are replaced.
    """
    docs = docs.drop("n_entities", "entity_kinds")
    row, hits, late, flag, own, new = fresh(docs, "__row", "__hits", "__late", "__flag", "__own", "__new")
    rows = docs.withColumn(row, F.xxhash64(id_col, text_col)).withColumn(hits, matches(F.col(text_col)))
    found = rows.filter(F.size(hits) > 0).select(F.col(row).alias("row"), F.explode(F.flatten(F.transform(hits, lambda x: x["entities"]))).alias("entity")).select("row", "entity.kind", "entity.norm").filter(~F.col("kind").isin("initial", "particle"))
    found = written(found, "found")
    retried = written(found.join(attempts(found, key), ["kind", "norm"]).groupBy("row").agg(F.collect_set(F.struct("kind", "norm", "attempt")).alias("late")), "retried")
    bits = map_bits(retried.count())
    flagged = with_flag(rows, map_place(bits, F.col(row)), group_map(retried, bits, "row"), flag)
    none = F.array().cast("array<struct<kind:string,norm:string,attempt:int>>")
    some = flagged.filter(flag).join(retried.toDF(own, late), F.col(row) == F.col(own), "left").withColumn(late, F.coalesce(F.col(late), none)).drop(own)
    rest = flagged.filter(~F.col(flag)).withColumn(late, none)

    def made(entity: Column) -> Column:
        other = F.get(F.filter(F.col(late), lambda x: (x["kind"] == entity["kind"]) & (x["norm"] == entity["norm"])), F.lit(0))["attempt"]
        full = _let(F.coalesce(other, F.lit(0)), lambda attempt: surrogate(entity["kind"], entity["norm"], attempt, key))
        return F.when(entity["kind"] == "particle", entity["norm"]).when(entity["kind"] == "initial", other_initials(entity["norm"], key)).otherwise(full)

    def replacement(m: Column) -> Column:
        def put(parts: Column) -> Column:
            first = F.get(parts, F.lit(0))
            return F.when(m["kind"] == "name", F.array_join(parts, " ")).when(m["kind"].isin("email", "ip", "ipv6"), first).when(m["kind"].isin("secret", "key"), first).otherwise(_filled(m["raw"], first))

        before = rf"^(?:{TITLE}|{NAMING})"
        parts = lambda made_: F.struct(put(made_).alias("new"), F.zip_with(m["entities"], made_, lambda e, n: F.struct(e["kind"].alias("kind"), e["norm"].alias("old"), n.alias("new"))).alias("parts"))
        return F.struct(F.regexp_extract(m["raw"], before, 0).alias("title"), _let(F.transform(m["entities"], made), parts).alias("made"))

    def replaced(df: DataFrame) -> DataFrame:
        """Texts without a match skip all that follows the search."""
        df = df.withColumn(new, F.transform(hits, replacement))
        parts = F.flatten(F.transform(new, lambda x: x["made"]["parts"]))
        words = F.array_distinct(F.transform(F.filter(parts, lambda x: x["kind"].isin(*NAMES)), lambda x: F.struct(x["old"].alias("old"), x["new"].alias("new"))))
        pieces = F.split(F.col(text_col), ANY, -1)
        pieces = _let(words, lambda known: F.when(F.size(known) > 0, F.transform(pieces, lambda p: _with_known(p, known))).otherwise(pieces))
        ends = F.concat(F.transform(new, lambda x: F.concat(x["title"], x["made"]["new"])), F.array(F.lit("")))
        text = F.when(F.size(hits) > 0, F.array_join(F.zip_with(pieces, ends, lambda p, n: F.concat(p, n)), "")).otherwise(F.col(text_col))
        kinds = F.array_join(F.sort_array(F.array_distinct(F.transform(hits, lambda x: x["kind"]))), ",")
        columns = [text.alias(c) if c == text_col else F.col(c) for c in docs.columns]
        return df.select(*columns, F.greatest(F.size(hits), F.lit(0)).alias("n_entities"), F.coalesce(kinds, F.lit("")).alias("entity_kinds"))

    return replaced(some).unionByName(replaced(rest))


def op9_pii(spark, sf_dir: str) -> DataFrame:
    return with_surrogates(table(spark, sf_dir, "documents").select("doc_id", "text"))
