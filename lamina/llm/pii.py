"""PII surrogates: detected entities receive keyed, type-consistent replacements.

The same entity gets the same surrogate in every document, other entities get others (checked over the whole corpus),
and a surrogate keeps type, layout, letter case, script, check digits where they were right, and the gender of a name.
Names are found after a title or by a given name of a short list, always with the capitalised words that follow.
DataFrame functions only.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Tables

NARROW = 5  # draws that keep the layout's size; each later one adds a letter, digit, syllable or octet
BROADCAST_ROWS = 200_000  # spellings with their surrogates, or ids of documents that hold any: some 30 MB

# Titles that precede a name, given names, and the shapes of each type. All repeats are bounded, possessive or exclude each other.
_MALE = r"Mr|Mister|Herr|Monsieur|Señor|Sr|Господин"
_FEMALE = r"Mrs|Ms|Miss|Frau|Madame|Mme|Señora|Sra|Госпожа"
_NEUTRAL = r"Dr|Prof|Professor|Doktor|Docteur|Доктор"
_MEN = (
    "James|John|Robert|Michael|William|David|Richard|Joseph|Thomas|Charles|Daniel|Matthew|Anthony|Mark|Steven|Paul|Andrew|Peter|George|Henry|Edward|Brian|Kevin|"
    "Hans|Karl|Klaus|Jürgen|Wolfgang|Stefan|Andreas|Matthias|Jean|Pierre|Michel|Philippe|François|Jacques|José|Juan|Carlos|Luis|Miguel|Antonio|Javier|Manuel|"
    "Иван|Пётр|Сергей|Александр|Дмитрий|Алексей"
)
_WOMEN = (
    "Mary|Patricia|Jennifer|Linda|Elizabeth|Barbara|Susan|Jessica|Sarah|Karen|Nancy|Lisa|Margaret|Sandra|Emily|Laura|Julia|Alice|Emma|Olivia|Helen|"
    "Ursula|Monika|Sabine|Petra|Claudia|Heike|Sophie|Catherine|Isabelle|Camille|Nathalie|Carmen|Lucía|Isabel|Elena|Pilar|Anna|Maria|María|"
    "Мария|Анна|Ольга|Елена|Наталья|Татьяна"
)
_CAPITAL = r"(?=[A-ZÀ-ÞА-Я])"  # what titles and given names begin with; cheap, and most places end there
_TITLE = rf"(?:{_MALE}|{_FEMALE}|{_NEUTRAL})\.? "
# A word of a name: inner capitals, apostrophes and hyphens (not the 's of a genitive), no title of a further name.
_WORD = (
    rf"(?!(?:{_MALE}|{_FEMALE})\.? \p{{Lu}})(?:\p{{Ll}}{{1,2}}['’])?\p{{Lu}}[\p{{L}}\p{{M}}]*+"
    r"(?:(?:[-‐‑]|['’](?![sS](?![\p{L}\p{M}])))\p{L}[\p{L}\p{M}]*+)*+"
)
# Names go on over spaces, the points of initials and of a few short forms, and these particles.
_NEXT = r"(?: |(?<=[ .-]\p{Lu}|[ .](?:Dr|St)|[ .]Prof)\.[ -]?)"
_PARTICLE = r"(?:(?:von|van|de|del|della|di|da|dos|du)(?: (?:der|den|dem|la|las|los|le))? )?"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
SHAPES = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"(?=[0-9a-fA-Fgs])(?<![0-9A-Za-z_-])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+|AKIA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}+|sk-[0-9A-Za-z]{20,}+)(?![0-9A-Za-z])",
    "iban": r"(?=[A-Z])(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[0-9A-Z]{4}){3,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?=\d)(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\d|\.\d)",
    "phone": r"(?=[+(\d])(?:(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-]))",
    "card": r"(?=\d)(?<![\w.])(?:\d{13,19}|\d{4}(?:[ -]\d{4}){3})(?!\w)",
    "person": (
        rf"{_CAPITAL}(?<!\p{{L}})(?:{_TITLE}{_PARTICLE}{_WORD}(?:{_NEXT}{_PARTICLE}{_WORD})*+"
        rf"|(?:{_MEN}|{_WOMEN})(?:-(?:{_MEN}|{_WOMEN}))?{_NEXT}{_PARTICLE}{_WORD}(?:{_NEXT}{_PARTICLE}{_WORD})*+)"
    ),
}
#: The stretches of a name: letters, or what parts them.
RUNS = r"[\p{L}\p{M}]+|[^\p{L}\p{M}]+"
ANY = "|".join(f"(?:{p})" for p in SHAPES.values())
#: What every entity holds, secrets of letters alone too; a text without it is passed by without the full pattern.
HINT = rf"[0-9@]|sk-|AKIA|gh[pousr]_|[a-f]{{32}}|[A-F]{{32}}|{_CAPITAL}(?<!\p{{L}})(?:{_TITLE}|(?:{_MEN}|{_WOMEN})[ -])"


def kind(entity: Column) -> Column:
    """The type whose shape the entity as a whole has; the first of SHAPES that fits."""
    out = F.lit("person")
    for name, shape in reversed(SHAPES.items()):
        out = F.when(entity.rlike(f"^(?:{shape})$"), F.lit(name)).otherwise(out)
    return out


def canonical(kind_: Column, entity: Column) -> Column:
    """What all spellings of one entity share: e-mail addresses and names in lower case, names without title, others without separators.

    A name's gender is its title's, else its given name's; a name without either counts as a man's.
    """
    bare = F.regexp_replace(entity, rf"^{_TITLE}", "")
    name = F.translate(F.lower(bare), "’‐‑", "'--")
    woman = entity.rlike(rf"^(?:{_FEMALE})\b") | (~entity.rlike(rf"^(?:{_MALE})\b") & bare.rlike(rf"^(?:{_WOMEN})(?!\p{{L}})"))
    return (
        F.when(kind_ == "email", F.lower(entity)).when(kind_ == "person", F.concat(F.when(woman, F.lit("f:")).otherwise(F.lit("m:")), name)).when(kind_ == "ip", entity)
        .when(kind_ == "secret", entity).when(kind_ == "phone", F.regexp_replace(entity, r"[^0-9+]", "")).otherwise(F.regexp_replace(entity, r"[^0-9A-Za-z]", ""))
    )


def _pick(seed: Column, at: Column, letters: str) -> Column:
    return F.substring(F.lit(letters), (F.pmod(F.xxhash64(seed, at), F.lit(len(letters))) + 1).cast("int"), F.lit(1))


def _same_class(seed: Column, c: Column, i: Column, lower: str = "abcdefghijklmnopqrstuvwxyz") -> Column:
    """A keyed character of c's class: digit, case and script stay; anything else is itself."""
    return (
        F.when(c.rlike("[0-9]"), _pick(seed, i, "0123456789")).when(c.rlike("[a-z]"), _pick(seed, i, lower)).when(c.rlike("[A-Z]"), F.upper(_pick(seed, i, lower)))
        .when(c.rlike(r"\p{IsCyrillic}"), F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(seed, i, "абвгдезиклмнопрстуфя"))).otherwise(_pick(seed, i, "абвгдезиклмнопрстуфя")))
        .when(c.rlike(r"\p{IsGreek}"), F.when(c.rlike(r"\p{Lu}"), F.upper(_pick(seed, i, "αβγδεζηθικλμνξοπρτυφχω"))).otherwise(_pick(seed, i, "αβγδεζηθικλμνξοπρτυφχω")))
        .when(c.rlike(r"\p{Ll}"), _pick(seed, i, "áàâäéèêëíìîïóòôöúùûüçñ")).when(c.rlike(r"\p{Lu}"), _pick(seed, i, "ÁÀÂÄÉÈÊËÍÌÎÏÓÒÔÖÚÙÛÜÇÑ"))
        .when(c.rlike(r"\p{L}"), _pick(seed, i, lower)).when(c.rlike(r"\p{N}"), _pick(seed, i, "0123456789")).otherwise(c)  # of other scripts: left as it is it could never differ
    )


def _luhn(digits: Column) -> Column:
    """The sum that is a multiple of 10 for a valid card number."""
    def value(c: Column, i: Column) -> Column:
        d = F.ascii(c) - 48
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return F.when(i % 2 == 1, doubled).otherwise(d)

    return F.aggregate(F.transform(F.reverse(F.split(digits, "")), value), F.lit(0), lambda a, x: a + x)


def _rest97(text: Column) -> Column:
    """The remainder modulo 97 of capitals and digits read as one number, A as 10 to Z as 35."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda r, c: F.pmod(r * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)).cast("int"))


def _mac(message: Column, key: str) -> Column:
    """HMAC-SHA256 in hex."""
    raw = key.encode()
    raw = (hashlib.sha256(raw).digest() if len(raw) > 64 else raw).ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ pad for b in raw)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def surrogate(kind_: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The keyed replacement of a canonical entity at one attempt, of the same type and layout."""
    seed = _mac(F.concat_ws("\u0001", kind_, canon, attempt.cast("string")), key)
    return F.transform(F.array(seed), lambda once: _drawn(kind_, canon, attempt, once))[0]


def _drawn(kind_: Column, canon: Column, attempt: Column, seed: Column) -> Column:
    chars = lambda s: F.split(s, "")
    more = F.greatest(attempt - (NARROW - 1), F.lit(0))
    # Keyed from places below 0, which nothing else uses.
    added = lambda n, draw: F.array_join(F.transform(F.array_repeat(F.lit(""), n), lambda _, k: draw(-1 - k)), "")
    digits = added(more, lambda k: _pick(seed, k, "0123456789"))
    plain = lambda s, **how: F.array_join(F.transform(chars(s), lambda c, i: _same_class(seed, c, i, **how)), "")
    tld = F.regexp_extract(canon, r"\.\p{L}+$", 0)
    email = F.concat(added(more, lambda k: _pick(seed, k, "abcdefghijklmnopqrstuvwxyz")), plain(F.substring(canon, F.lit(1), F.char_length(canon) - F.char_length(tld))), tld)

    def octet(o: Column, i: Column) -> Column:
        n = F.pmod(F.xxhash64(seed, i), F.lit(1 << 40))
        by_length = F.when(F.char_length(o) == 1, n % 10).when(F.char_length(o) == 2, 10 + n % 90).otherwise(100 + n % 156)
        return F.when(more == 0, by_length).otherwise(n % 256).cast("string")  # short forms run out first

    octets = added(F.greatest(more - NARROW, F.lit(0)), lambda k: F.concat(F.lit("."), F.pmod(F.xxhash64(seed, k), F.lit(256)).cast("string")))
    ip = F.concat(F.array_join(F.transform(F.split(canon, r"\."), octet), "."), octets)
    hexes = F.array_join(F.transform(chars(canon), lambda c, i: F.when(c.rlike("[0-9a-f]"), _pick(seed, i, "0123456789abcdef")).otherwise(_pick(seed, i, "0123456789ABCDEF"))), "")
    secret = F.when(canon.rlike(r"^(?:[0-9a-f]+|[0-9A-F]+)$"), hexes).otherwise(F.concat(F.regexp_extract(canon, r"^(?:AKIA|gh._|sk-)", 0), plain(F.regexp_replace(canon, r"^(?:AKIA|gh._|sk-)", ""))))
    # Check digits that were right are right again, others stay wrong: an account number by 97, a card by Luhn.
    account = F.concat(plain(F.substring(canon, F.lit(5), F.char_length(canon))), digits)
    turned = lambda c: F.concat(F.substring(c, F.lit(5), F.char_length(c)), F.substring(c, 1, 4))
    right = F.lit(98) - _rest97(F.concat(account, F.substring(canon, 1, 2), F.lit("00")))
    wrong = F.pmod(right + 1 + F.pmod(F.xxhash64(seed), F.lit(90)).cast("int"), F.lit(97))
    iban = F.concat(F.substring(canon, 1, 2), F.lpad(F.when(_rest97(turned(canon)) == 1, right).otherwise(wrong).cast("string"), 2, "0"), account)
    number = lambda k, size, low: F.lpad((F.pmod(F.xxhash64(seed, F.lit(k)), F.lit(size)) + low).cast("string"), len(str(size)), "0")
    area = number(1, 898, 1)
    ssn = F.concat(F.when(area == "666", F.lit("899")).otherwise(area), number(2, 99, 1), number(3, 9999, 1), digits)  # no part is all zeros
    calling = F.regexp_extract(canon, r"^\+(?:[17]|\d\d)", 0)
    phone = F.concat(calling, plain(F.substring(canon, F.char_length(calling) + 1, F.char_length(canon))), digits)
    # A card keeps its first digit, and whether its check digit is right.
    body = F.concat(F.substring(canon, 1, 1), plain(F.substring(canon, F.lit(2), F.char_length(canon) - 2)), digits)
    check = F.pmod(F.lit(10) - _luhn(F.concat(body, F.lit("0"))) % 10, F.lit(10))
    shift = F.when(_luhn(canon) % 10 == 0, F.lit(0)).otherwise(1 + F.pmod(F.xxhash64(seed), F.lit(9)).cast("int"))
    card = F.concat(body, F.pmod(check + shift, F.lit(10)).cast("string"))
    # A name keeps its stretches of letters, initials and what parts them; given names end as is usual for the gender.
    latin = ~canon.rlike(r"\p{IsCyrillic}")
    def name(w: Column, i: Column) -> Column:
        syllable = lambda k: F.when(latin, F.concat(_pick(seed, i * 8 + k, "bdfglmnrstv"), _pick(seed, i * 8 + k + 4, "aeiou"))).otherwise(F.concat(_pick(seed, i * 8 + k, "бдглмнрств"), _pick(seed, i * 8 + k + 4, "аеиоу")))
        end = F.when(canon.startswith("f:"), F.when(latin, F.lit("na")).otherwise(F.lit("на"))).otherwise(F.when(latin, F.lit("ron")).otherwise(F.lit("рон")))
        initial = _pick(seed, i * 8, "abcdefghijklmnoprstuvwyz")
        initial = F.when(latin, initial).otherwise(_pick(seed, i * 8, "абвгдезиклмнопрстуфя"))
        long = F.concat(syllable(0), syllable(1), syllable(2), F.when(i == 0, end).otherwise(F.lit("")))
        return F.when(~w.rlike(r"^\p{L}"), w).when(F.char_length(w) == 1, initial).otherwise(long)

    words = F.regexp_extract_all(F.substring(canon, F.lit(3), F.char_length(canon)), F.lit(RUNS), F.lit(0))
    syllables = added(more, lambda k: F.when(latin, F.concat(_pick(seed, 2 * k, "bdfglmnrstv"), _pick(seed, 2 * k + 1, "aeiou"))).otherwise(F.concat(_pick(seed, 2 * k, "бдглмнрств"), _pick(seed, 2 * k + 1, "аеиоу"))))
    person = F.concat(F.substring(canon, 1, 2), F.array_join(F.transform(words, name), ""), syllables)
    return (
        F.when(kind_ == "email", email).when(kind_ == "ip", ip).when(kind_ == "secret", F.concat(secret, digits)).when(kind_ == "iban", iban).when(kind_ == "card", card).when(kind_ == "ssn", ssn).when(kind_ == "phone", phone)
        .when(kind_ == "person", person).otherwise(F.concat(plain(canon), digits))
    )


def spell(kind_: Column, entity: Column, value: Column) -> Column:
    """The surrogate in the layout of one spelling: its separators, its letter case, its title."""
    title = F.regexp_extract(entity, rf"^{_TITLE}", 0)
    value = F.when(kind_ == "phone", F.replace(value, F.lit("+"), F.lit(""))).otherwise(value)
    place = lambda i: F.char_length(F.regexp_replace(F.substring(entity, F.lit(1), i + 1), r"[^0-9A-Za-z]", ""))
    laid = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike("[0-9A-Za-z]"), F.substring(value, place(i), F.lit(1))).otherwise(c)), "")
    laid = F.concat(laid, F.substring(value, place(F.char_length(entity)) + 1, F.char_length(value)))  # what later draws have added
    front = F.greatest(F.char_length(value) - F.char_length(entity), F.lit(0))
    cased = F.array_join(F.transform(F.split(entity, ""), lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.substring(value, front + i + 1, F.lit(1)))).otherwise(F.substring(value, front + i + 1, F.lit(1)))), "")
    cased = F.concat(F.substring(value, F.lit(1), front), cased)

    def word(e: Column, v: Column) -> Column:
        shape = F.when(e.rlike(r"^\p{Lu}{2}") & ~e.rlike(r"\p{Ll}"), F.upper(v)).when(e.rlike(r"^\p{Ll}"), v).otherwise(F.initcap(v))
        return F.when(e.rlike(r"^\p{L}"), shape).otherwise(e)

    runs = lambda s: F.regexp_extract_all(s, F.lit(RUNS), F.lit(0))
    named = F.array_join(F.zip_with(runs(F.substring(entity, F.char_length(title) + 1, F.char_length(entity))), runs(F.substring(value, F.lit(3), F.char_length(value))), word), "")
    return (
        F.when(kind_ == "email", cased).when(kind_ == "person", F.concat(title, named))
        .when(kind_.isin("ip", "secret"), value).otherwise(laid)
    )


def distinct_surrogates(entities: DataFrame, key: str) -> DataFrame:
    """kind, canon, value: no two entities of a kind share a value, and no value is itself an entity.

    Of those that collide, the smallest canon keeps its value and the others are drawn again; two jobs a round over the
    distinct entities, and in practice one or two rounds. From draw NARROW on the space grows with every draw, so that it
    can't run out: a letter before an e-mail address, a syllable after a name, digits at the end of the others; an ip
    takes octets of any length, and after as many draws again octets beyond the fourth. Then the layout isn't kept.
    """
    if not key:
        raise ValueError("a key must be given: who knows it can tell which surrogate an entity gets")
    with Tables(entities.sparkSession) as t:
        now = t.write(entities.select("kind", "canon").distinct().withColumn("attempt", F.lit(0)).withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key)), "surrogates")
        real = t.write(now.select("kind", F.col("canon").alias("value"), F.lit(True).alias("taken")), "real")
        while True:  # the space of those that are drawn again grows without end
            first = now.groupBy("kind", "value").agg(F.min("canon").alias("first"))
            marked = now.join(first, ["kind", "value"]).join(real, ["kind", "value"], "left")
            again = (F.col("canon") != F.col("first")) | F.coalesce("taken", F.lit(False))
            marked = t.write(marked.select("kind", "canon", "attempt", "value", again.alias("again")), "marked")
            t.drop(now)
            if marked.where("again").isEmpty():
                return t.keep(marked.select("kind", "canon", "value"), "surrogates")
            bad = marked.where("again").select("kind", "canon", (F.col("attempt") + 1).alias("attempt"))
            drawn = bad.withColumn("value", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
            now = t.write(marked.where("not again").drop("again").unionByName(drawn), "surrogates")
            t.drop(marked)


def replace_pii(docs: DataFrame, key: str, broadcast_rows: int = BROADCAST_ROWS) -> DataFrame:
    """doc_id, n_entities, kinds (sorted, distinct), text with every entity replaced; one row per row of docs.

    The full pattern goes over a text once, and once more where it found any. Documents without an entity keep
    their text and aren't shuffled: they are those whose id isn't among the ids that hold any, broadcast up to
    `broadcast_rows`; only rows under such an id are looked at again. Spellings are broadcast to the documents up to as
    many, and shuffled beyond. Null text stays null with no entities; repeated rows each stay; an empty table gives none;
    further columns are ignored; of a very long text the words found are held as one array.
    """
    text = F.col("text")
    found = F.when(text.rlike(HINT), F.regexp_extract_all("text", F.lit(ANY), F.lit(0)))
    with Tables(docs.sparkSession) as t:
        # The one-row generator keeps the pattern from being run again by the filter on what it found.
        seen = docs.select("doc_id", "text", F.explode(F.array(found)).alias("found")).where(F.size("found") > 0)
        held = t.keep(seen.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", "found"), "entities")
        ids = t.keep(held.select("doc_id").distinct(), "ids")
        each = held.select("rid", F.explode(F.array_distinct("found")).alias("entity"))
        spelled = each.select("entity").distinct().withColumn("kind", kind(F.col("entity"))).withColumn("canon", canonical(F.col("kind"), F.col("entity")))
        spelled = t.write(spelled, "spellings")
        values = distinct_surrogates(spelled, key)
        table = spelled.join(values, ["kind", "canon"]).select("entity", "kind", spell(F.col("kind"), F.col("entity"), F.col("value")).alias("value"))
        table = t.keep(table, "table")
    holds = F.coalesce(text.rlike(HINT) & text.rlike(ANY), F.lit(False))
    if ids.count() <= broadcast_rows:
        d = docs.alias("d").join(F.broadcast(ids).alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_anti").select("doc_id", "text")
        twin = docs.alias("d").join(F.broadcast(ids).alias("i"), F.col("d.doc_id").eqNullSafe(F.col("i.doc_id")), "left_semi").select("doc_id", "text")
        # The generator keeps the pattern above the join, where few texts are left.
        twin = twin.select("doc_id", "text", F.explode(F.array(holds)).alias("holds")).where("not holds").drop("holds")
        clean = d.unionByName(twin)
    else:
        clean = docs.select("doc_id", "text").where(~holds)
    clean = clean.select("doc_id", F.lit(0).alias("n_entities"), F.array().cast("array<string>").alias("kinds"), "text")
    small = F.broadcast(table) if table.count() <= broadcast_rows else table
    per = each.join(small, "entity").groupBy("rid").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "value"))).alias("by"), F.sort_array(F.collect_set("kind")).alias("kinds")
    )
    gaps = F.split("text", ANY, -1)
    rest = F.zip_with("found", F.slice("gaps", F.lit(2), F.size("found")), lambda e, g: F.concat(F.element_at("by", e), g))
    fixed = held.join(per, "rid").withColumn("gaps", gaps).select(
        "doc_id", F.size("found").alias("n_entities"), "kinds", F.concat(F.element_at("gaps", 1), F.array_join(rest, "")).alias("text")
    )
    return clean.unionByName(fixed)
