"""Personal data: detected entities get keyed surrogates of their own type and format.

Method (DataFrame functions only)
---------------------------------
1. One pattern finds e-mail addresses, phone numbers (international, and the national forms
   of North America, France and Germany), IPv4 addresses, payment cards, social-security
   numbers, IBANs, access keys and names after a form of address.  Cards must pass the Luhn
   check and IBANs the mod-97 check; what fails stays as it is.  It runs once over all texts.
2. An occurrence is reduced to its entity (case and punctuation dropped where they carry
   no identity, country code put before a North American number), so all its spellings are
   one entity: coreference holds over the corpus.  Given and family names are entities of
   their own, so that Mrs. Anna Schmidt and Mrs. Schmidt stay one family; where a text
   names one after a form of address, its bare mentions in that text change as well.
3. A surrogate is drawn from SHA-512 of (key, kind, entity, round): letters give letters of
   their script, digits give digits, a card keeps its issuer digit and passes Luhn, a phone
   number its country code, an IBAN its country, a given name its gender, an address its
   top-level domain.
4. Collision checks: a surrogate that another entity has or that is itself an entity of the
   corpus is drawn again with the next round, until all are distinct.  From round to round
   names grow, from round GROW on all kinds do, so the rounds end even where entities
   take up all values of their format.
5. Occurrences get the surrogate in their own format, and texts are put together again
   from the pieces between matches.

Only entities and ids are grouped; an entity with a large share of all occurrences is
joined by broadcast.  Texts are shuffled only where they hold an entity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import bounded, discard, free_name, table, weighted_join, written

#: Round from which a surrogate gets one character more than its entity.
GROW = 4

_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
# Forms of address by gender.
MALE = "Mr|Herr|Herrn|Monsieur|Señor|Sr|господин"
FEMALE = "Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|госпожа"
_TITLE = rf"(?:{MALE}|{FEMALE})\.?"
_EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
_SECRET = r"\b[0-9a-f]{40}\b"
_IP = rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?\d)"
_SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
_CARD = r"(?<![\d.-])\d(?:[ -]?\d){12,18}(?![\d-])"
# A group of a phone number does not begin where another entity does; a number of country
# code 1 has ten digits more, any other at most 15 in all.
_GROUP = rf"(?![ .-]?(?:{_EMAIL}|{_SECRET}|{_IP}))[ .-]?\d{{2,4}}"
_GROUPED = r"(?<![\d.-])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3}(?:[ -]\d{1,3})?|\d{4}[ -]\d{6}[ -]\d{5})(?![ -]?\d)"  # a card by its own groups
_NEXT = rf"(?![ .-]?(?:{_SSN}|{_GROUPED})){_GROUP}"
_MORE = r"[ .()-]{0,2}\d"  # written out 15 times, as Java bounds no repeated group that looks behind
_PHONE = (
    r"(?<![\d+])\+(?:1[ .-]?(?:\(\d{3}\)|\d{3})[ .-]?\d{3}[ .-]?\d{4}(?!\d)"
    rf"|\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)|\d{{1,4}}){_GROUP}(?:{_NEXT}){{1,3}}(?!\d)(?<!\d{_MORE * 15}))"
)
# National forms: North American, French, German.
_NANP = r"(?<![\d+.-])(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[.-]\d{4}(?!\d|[.-]\d)"
_NATIONAL = rf"{_NANP}|(?<![\d+.-])0[1-9](?:[ .]\d{{2}}){{4}}(?!\d|[ .]\d)|(?<![\d+./-])0\d{{2,4}}[ /-]\d{{6,8}}(?![\d/-])"
# Country calling codes of two digits (those of 1 and 7 have one, all others three).
_TWO_DIGITS = "20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split()
#: (kind, pattern), the first that matches a place wins.  Runs begin at a border or are
#: bounded, so that a long text without an entity is read in linear time.
KINDS: tuple[tuple[str, str], ...] = (
    ("email", _EMAIL),
    ("access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b"),
    ("secret", _SECRET),
    ("ip", _IP),
    ("phone", f"{_PHONE}|{_NATIONAL}"),
    ("ssn", _SSN),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b"),
    ("card", _CARD),
    ("name", rf"(?<![\p{{L}}]){_TITLE} \p{{Lu}}[\p{{Ll}}'-]+(?: \p{{Lu}}[\p{{Ll}}'-]+)?"),
)
#: No kind begins right after a Latin letter, but with a digit or a plus sign; saying so
#: first spares the alternatives inside words.
PATTERN = r"(?:(?<![A-Za-z])|(?=[0-9+]))(?:" + "|".join(f"(?:{p})" for _, p in KINDS) + ")"

# Given names of surrogates.
_GIVEN = {
    "m": "Adam Bruno Carl David Emil Felix Georg Hugo Ivan Jonas Karl Leon Martin Noel Oscar Paul Robert Simon Thomas Victor".split(),
    "f": "Alma Berta Clara Diana Emma Flora Greta Hanna Irma Julia Karla Lena Maria Nora Olga Paula Rosa Sofia Tina Vera".split(),
    "mc": "Антон Борис Виктор Глеб Денис Егор Иван Кирилл Лев Максим".split(),
    "fc": "Анна Вера Дарья Елена Жанна Зоя Ирина Кира Лидия Мария".split(),
}
_LATIN, _CYRILLIC, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшэюя", "0123456789"


def _luhn_sum(digits: Column, double_last: bool) -> Column:
    """Luhn sum; ``double_last`` if the check digit is still to follow."""
    at = F.sequence(F.lit(1), F.length(digits))
    odd = 0 if double_last else 1

    def value(i):
        d = F.substring(digits, i, F.lit(1)).cast("int")
        twice = (F.length(digits) - i) % 2 == odd
        return F.when(twice, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)

    return F.aggregate(F.transform(at, value), F.lit(0), lambda a, x: a + x)


def _iban_ok(iban: Column) -> Column:
    """Mod-97 check over letters as two-digit numbers, digit by digit."""
    turned = F.concat(F.substring(iban, F.lit(5), F.length(iban)), F.substring(iban, F.lit(1), F.lit(4)))
    digits = F.array_join(
        F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), ""
    )
    return F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97) == 1


def _kind(found: Column) -> Column:
    kind = None
    for name, pattern in KINDS:
        test = found.rlike(f"^(?:{pattern})$")
        kind = F.when(test, name) if kind is None else kind.when(test, name)
    return kind


def _entity(kind: Column, found: Column) -> Column:
    """What makes two occurrences the same entity; of a name its last part, the family."""
    digits = F.regexp_replace(found, r"\D", "")
    return (
        F.when(kind == "email", F.lower(found))
        .when((kind == "phone") & found.rlike(f"^(?:{_NANP})$"), F.concat(F.lit("1"), digits))
        .when(kind.isin("phone", "ssn", "card"), digits)
        .when(kind == "iban", F.replace(found, F.lit(" "), F.lit("")))
        .when(kind == "name", F.concat(F.lit("n:"), F.lower(_family(found))))
        .otherwise(found)
    )


def _family(found: Column) -> Column:
    return F.substring_index(found, " ", -1)


def _given(found: Column) -> Column:
    """The given name as it is spelled; empty if there is none."""
    return F.regexp_extract(found, rf"^{_TITLE} (\S+) ", 1)


def _gender(found: Column) -> Column:
    return F.when(found.rlike(rf"^(?:{FEMALE})\.? "), "f").otherwise("m")


def _draw(key: str, kind: Column, entity: Column, turn: int) -> Column:
    """Hex digits, four a character, enough for the entity and 32 characters more."""
    blocks = F.sequence(F.lit(0), F.floor((F.length(entity) + 32) / 32).cast("int"))
    block = lambda b: F.sha2(F.concat_ws("\x00", F.lit(key), kind, entity, F.lit(str(turn)), b.cast("string")).cast("binary"), 512)
    return F.array_join(F.transform(blocks, block), "")


def _number(draw: Column, i) -> Column:
    return F.conv(F.substring(draw, i * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _pick(draw: Column, i, letters: str) -> Column:
    return F.substring(F.lit(letters), _number(draw, i) % len(letters) + 1, F.lit(1))


def _masked(draw: Column, s: Column, keep: Column) -> Column:
    """Each letter and digit after the first ``keep`` characters changed to one of its kind."""

    def change(c, i):
        new = (
            F.when(c.rlike("[0-9]"), _pick(draw, i, _DIGITS)).when(c.rlike("[a-zà-öø-ÿ]"), _pick(draw, i, _LATIN))
            .when(c.rlike("[A-ZÀ-ÖØ-Þ]"), F.upper(_pick(draw, i, _LATIN))).when(c.rlike("[а-яё]"), _pick(draw, i, _CYRILLIC)).otherwise(c)
        )
        return F.when(i < keep, c).otherwise(new)

    return F.array_join(F.transform(F.split(s, ""), change), "")


def _surrogate(kind: Column, entity: Column, turn: int) -> Column:
    draw, more = F.col("draw"), max(0, turn - GROW + 1)
    longer = lambda c: F.concat(entity, F.lit(c * more))
    tld = F.regexp_extract(entity, r"\.[a-z]+$", 0)
    email = F.concat(_masked(draw, F.concat(F.lit("a" * more), F.substring(entity, F.lit(1), F.length(entity) - F.length(tld))), F.lit(0)), tld)
    partial = _masked(draw, F.substring(longer("0"), F.lit(1), F.length(entity) + more - 1), F.lit(1))
    card = F.concat(partial, ((10 - _luhn_sum(partial, True) % 10) % 10).cast("string"))
    octets = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: (_number(draw, i) % 254 + 1).cast("string")), ".")
    if more:  # addresses of version 4 may all be taken
        octets = F.concat(F.lit("fd"), F.concat_ws(":", *(F.substring(draw, k, 4 if k > 1 else 2) for k in (1, 5, 9, 13, 17, 21, 25, 29))))
    secret = F.array_join(F.transform(F.split(longer("0"), ""), lambda c, i: _pick(draw, i, "0123456789abcdef")), "")
    country = F.when(entity.rlike("^[017]"), 1).when(F.substring(entity, 1, 2).isin(*_TWO_DIGITS), 2).otherwise(3)
    return (
        F.when(kind == "email", email).when(kind == "card", card).when(kind == "ip", octets).when(kind == "secret", secret)
        .when(kind == "access_key", _masked(draw, longer("A"), F.lit(4))).when(kind == "name", _name(entity, draw, turn))
        .when(kind == "iban", _iban(longer("0"), draw)).otherwise(_masked(draw, longer("0"), F.when(kind == "phone", country).otherwise(0)))
    )


def _name(entity: Column, draw: Column, turn: int) -> Column:
    """A given name of the list in the first round; else a made-up name, longer in each round."""
    cyrillic, female, family = entity.rlike("[а-яё]"), entity.startswith("f:"), entity.startswith("n:")
    tail = F.sequence(F.lit(1), F.lit(min(6 + 2 * turn, 28)))
    word = lambda consonants, vowels: F.initcap(
        F.array_join(F.transform(tail, lambda i: F.when(i % 2 == 1, _pick(draw, i, consonants)).otherwise(_pick(draw, i, vowels))), "")
    )
    made = F.when(cyrillic, word("бвгдзклмнпрст", "аеиоу")).otherwise(word("bdfghklmnprstvz", "aeiou"))
    if turn:
        ending = F.when(family, "").when(cyrillic & female, "на").when(cyrillic, "р").when(female, "na").otherwise("r")
        return F.concat(made, ending)
    given = lambda g: F.element_at(F.array(*map(F.lit, _GIVEN[g])), _number(draw, F.lit(0)) % len(_GIVEN[g]) + 1)
    return F.when(family, made).when(cyrillic & female, given("fc")).when(cyrillic, given("mc")).when(female, given("f")).otherwise(given("m"))


def _iban(entity: Column, draw: Column) -> Column:
    """Same country and length, check digits made right."""
    body = F.substring(_masked(draw, entity, F.lit(4)), F.lit(5), F.length(entity))
    turned = F.concat(body, F.substring(entity, F.lit(1), F.lit(2)), F.lit("00"))
    digits = F.array_join(
        F.transform(F.split(turned, ""), lambda c: F.when(c.rlike("[A-Z]"), (F.ascii(c) - 55).cast("string")).otherwise(c)), ""
    )
    check = 98 - F.aggregate(F.split(digits, ""), F.lit(0), lambda a, c: (a * 10 + c.cast("int")) % 97)
    return F.concat(F.substring(entity, F.lit(1), F.lit(2)), F.lpad(check.cast("string"), 2, "0"), body)


def _formatted(kind: Column, found: Column, surrogate: Column, given: Column) -> Column:
    """The surrogate in the occurrence's own spelling; what is longer follows at the end."""
    start = F.struct(F.lit("").alias("s"), F.lit(1).alias("k"))
    own = F.when((kind == "phone") & found.rlike(f"^(?:{_NANP})$"), F.substring(surrogate, F.lit(2), F.length(surrogate))).otherwise(surrogate)

    def put(a, c):
        new = F.substring(own, a["k"], F.lit(1))
        cased = F.when(c.rlike("[A-Z]"), F.upper(new)).otherwise(new)
        return F.when(c.rlike("[0-9A-Za-z]"), F.struct(F.concat(a["s"], cased).alias("s"), (a["k"] + 1).alias("k"))).otherwise(
            F.struct(F.concat(a["s"], c).alias("s"), a["k"].alias("k"))
        )

    spaced = F.aggregate(F.split(found, ""), start, put, lambda a: F.concat(a["s"], F.substring(own, a["k"], F.length(own))))
    upper = lambda c, i: F.when(F.substring(found, i + 1, F.lit(1)).rlike("[A-Z]"), F.upper(c)).otherwise(c)
    cased = F.array_join(F.transform(F.split(surrogate, ""), upper), "")
    name = F.concat(F.regexp_extract(found, rf"^{_TITLE} ", 0), F.coalesce(F.concat(given, F.lit(" ")), F.lit("")), surrogate)
    return (
        F.when(kind.isin("phone", "ssn", "card", "iban"), spaced).when(kind == "email", cased)
        .when(kind == "name", name).otherwise(surrogate)
    )


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """(kind, entity, surrogate) for distinct (kind, entity); surrogates of a kind are
    distinct, and none is an entity itself."""
    entities = written(entities.select("kind", "entity").distinct(), "entities")
    pending, done, turn = entities, None, 0
    bare = lambda kind, s: F.when(kind == "name", F.lower(s)).otherwise(s)
    real = entities.select("kind", bare(F.col("kind"), F.regexp_replace("entity", "^[mfn]:", "")).alias("taken"))
    while True:
        drawn = pending.withColumn("draw", _draw(key, F.col("kind"), F.col("entity"), turn))
        drawn = drawn.select("kind", "entity", _surrogate(F.col("kind"), F.col("entity"), turn).alias("surrogate"))
        drawn = written(drawn.withColumn("taken", bare(F.col("kind"), F.col("surrogate"))), "drawn")
        first = drawn.groupBy("kind", "taken").agg(F.min("entity").alias("entity"))
        used = real if done is None else real.union(done.select("kind", bare(F.col("kind"), F.col("surrogate"))))
        good = first.join(used, ["kind", "taken"], "left_anti")
        new = drawn.join(good.drop("taken"), ["kind", "entity"], "left_semi").select("kind", "entity", "surrogate")
        old, done = done, written(new if done is None else done.union(new), "surrogates")
        discard(old)
        old, pending = pending, written(pending.join(done, ["kind", "entity"], "left_anti"), "pending")
        discard(drawn, old if old is not entities else None)
        turn += 1
        if pending.isEmpty():
            discard(pending)
            return done


def _occurrences(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, mark, pos, found, kind, entity, given) of every match; kind is null if its check fails."""
    text = F.col(text_col).cast("string")
    matches = docs.select(
        F.col(id_col).alias("id"), F.xxhash64(F.coalesce(text, F.lit(""))).alias("mark"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0)).alias("all")
    )
    found = matches.select("id", "mark", F.posexplode("all").alias("pos", "found"))
    found = found.withColumn("kind", _kind(F.col("found"))).withColumn("entity", _entity(F.col("kind"), F.col("found")))
    valid = F.when(F.col("kind") == "card", _luhn_sum(F.col("entity"), False) % 10 == 0).when(F.col("kind") == "iban", _iban_ok(F.col("entity")))
    found = found.withColumn("kind", F.when(F.coalesce(valid, F.lit(True)), F.col("kind")))
    given = F.when((F.col("kind") == "name") & (_given(F.col("found")) != ""), F.concat(_gender(F.col("found")), F.lit(":"), F.lower(_given(F.col("found")))))
    return found.withColumn("given", given)


def replace_private(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in the text and one new column, n_replaced (long).

    ``key`` is the secret that surrogates derive from.  n_replaced counts the matches that
    changed; bare mentions of their names change with them and are not counted.  Null
    text stays null, texts without an entity stay as they are.  Repeated rows and
    null ids get the same replacements each.  Other columns stay whatever their names
    (n_replaced gets underscores if taken).  An empty table gives no rows.
    """
    found = written(_occurrences(docs, id_col, text_col), "found")
    known = found.where("kind IS NOT NULL")
    every = known.select("kind", "entity").union(known.where("given IS NOT NULL").select("kind", F.col("given").alias("entity")))
    counts = written(every.groupBy("kind", "entity").agg(F.count("*").alias("n")), "counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    who = lambda kind, entity: F.concat_ws(":", F.col(kind), F.col(entity))
    mapped = surrogates(counts, key).join(counts, ["kind", "entity"])
    mapped = written(mapped.select(who("kind", "entity").alias("who"), "surrogate", "n"), "mapped")
    known = weighted_join(known.withColumn("who", who("kind", "entity")), mapped, "who", "n", total).drop("who", "n")
    first = mapped.withColumnRenamed("surrogate", "first")
    both = weighted_join(known.where("given IS NOT NULL").withColumn("who", who("kind", "given")), first, "who", "n", total).drop("who", "n")
    rows = both.unionByName(known.where("given IS NULL").withColumn("first", F.lit(None).cast("string")))
    rows = rows.unionByName(found.where("kind IS NULL").withColumn("surrogate", F.lit(None).cast("string")).withColumn("first", F.lit(None).cast("string")))
    new = F.when(F.col("surrogate").isNotNull(), _formatted(F.col("kind"), F.col("found"), F.col("surrogate"), F.col("first"))).otherwise(F.col("found"))
    pair = lambda old, to: F.struct(old.alias("old"), to.alias("to"))
    names = F.when(F.col("kind") == "name", F.filter(
        F.array(pair(_family(F.col("found")), F.col("surrogate")), pair(_given(F.col("found")), F.col("first"))), lambda x: F.length(x["old"]) > 2
    ))
    rows = rows.select("id", "mark", F.struct("pos", new.alias("new"), F.col("surrogate").isNotNull().alias("changed"), names.alias("names")).alias("c"))
    changes, of, mark, count = (free_name(docs, n) for n in ("pii_changes", "pii_id", "pii_mark", "n_replaced"))
    rows = rows.groupBy(F.col("id").alias(of), F.col("mark").alias(mark)).agg(F.array_sort(F.collect_set("c")).alias(changes))
    rows = written(rows, "changes")
    text = F.col(text_col).cast("string")
    here = lambda side: docs[id_col].eqNullSafe(side[of]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == side[mark])
    ids = written(rows.select(of, mark), "ids")
    same = docs.join(bounded(ids), here(ids), "left_anti").select("*", F.lit(0).cast("long").alias(count))
    hits = docs.join(bounded(ids), here(ids), "left_semi")
    hits = hits.join(rows, here(rows))
    named = F.array_distinct(F.flatten(F.filter(F.transform(F.col(changes), lambda c: c["names"]), lambda x: x.isNotNull())))
    bare = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}'-])"), n["old"], F.lit(r"(?![\p{L}-])")), n["to"])
    piece = lambda p: F.aggregate(named, p, bare)
    joined = F.array_join(F.transform(F.split(text, PATTERN, -1), lambda p, i: F.concat(piece(p), F.coalesce(F.get(F.col(changes), i)["new"], F.lit("")))), "")
    hits = hits.select(
        *(joined.alias(text_col) if c == text_col else F.col(f"`{c}`") for c in docs.columns),
        F.size(F.filter(F.col(changes), lambda c: c["changed"])).cast("long").alias(count),
    )
    return same.union(hits)


#: Key of the query below; a real run brings its own secret.
QUERY_KEY = "key of the op8 query"


def op8_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_private(table(spark, sf_dir, "documents").select("doc_id", "text"), QUERY_KEY)
