r"""Personal data: detected entities get keyed surrogates of the same type, script, gender and format.

One pattern finds e-mail addresses, IPv4 addresses, phone, social security, account (IBAN) and card
numbers, hexadecimal secrets, and names behind an honorific. The distinct entities of the corpus form
a table; a surrogate depends on the key, the type and the entity alone, so an entity gets the same
surrogate wherever it stands (coreference).

* Numbers go through a keyed Feistel permutation of their digits (cards keep whether their check digit
  is right, IPv4 permutes 32 bits), laid back into the original punctuation. A permutation has no collisions.
* E-mail local parts, secrets, IBANs and names are drawn by keyed hash in the shape of the original:
  letters for letters in their case, digits for digits, names by gender of the honorific and by script.

Collision check: a surrogate must belong to one entity and must be no entity of the corpus itself.
Entities that fail draw again (numbers: one more pass of the permutation would still be one-to-one, and
is used as the next draw) until none fails; the first of a colliding group keeps its surrogate. From the
fourth draw on, drawn surrogates get longer, so the loop ends.

Built-in functions only. Documents without an entity pass without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skuforge.llm.common import table
from skuforge.plans.results import written

KEY = "surrogate-key-1"

# Honorifics, and names by script and gender.
HONORIFICS = {
    "male": ("Mr", "Sir", "Herr", "Monsieur", "Señor", "Don", "господин"),
    "female": ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Señora", "Doña", "госпожа"),
    "any": ("Dr", "Prof"),
}
NAMES = {
    ("latin", "male"): ("James", "Robert", "Daniel", "Thomas", "Lukas", "Felix", "Pierre", "Antoine", "Diego", "Pablo", "Oscar", "Hugo", "Martin", "Adrian", "Victor", "Simon"),
    ("latin", "female"): ("Mary", "Laura", "Emily", "Sarah", "Anna", "Lena", "Camille", "Chloe", "Lucia", "Elena", "Clara", "Julia", "Irene", "Nora", "Alice", "Marta"),
    ("cyrillic", "male"): ("Иван", "Алексей", "Дмитрий", "Сергей", "Николай", "Павел", "Андрей", "Михаил"),
    ("cyrillic", "female"): ("Анна", "Мария", "Ольга", "Елена", "Ирина", "Наталья", "Татьяна", "Светлана"),
}
SURNAMES = {
    "latin": ("Walker", "Bennett", "Carter", "Hughes", "Weber", "Schneider", "Vogel", "Keller", "Moreau", "Girard", "Lambert", "Navarro", "Ortega", "Molina", "Serrano", "Duran"),
    "cyrillic": ("Орлов", "Волков", "Белов", "Козлов", "Морозов", "Лебедев", "Соколов", "Зайцев"),
}

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
_TITLES = "|".join(t for group in HONORIFICS.values() for t in group)
#: type -> pattern; the first that matches at a place wins.
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "secret": r"(?<![0-9A-Za-z])[0-9a-fA-F]{32,64}(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])",
    "phone": r"(?<![\d+])\+?\d{0,3}[ -]?\(\d{2,4}\)[ -]?\d{3}[ -]?\d{4}(?!\d)|(?<![\d-])\d{3}-\d{3}-\d{4}(?![\d-])|(?<![\d+])\+\d{1,3}(?:[ -]\d{2,4}){3,4}(?!\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\d|\.\d)",
    "card": r"(?<!\d)\d(?:[ -]?\d){12,18}(?!\d)",
    "name": rf"(?<!\p{{L}})(?:{_TITLES})\.? \p{{Lu}}\p{{L}}+(?: \p{{Lu}}\p{{L}}+)?",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: No entity without one of these.
HINT = rf"[0-9@]|[a-fA-F]{{32}}|(?:{_TITLES})\.? \p{{Lu}}"
NUMBERS = ("phone", "ssn", "ip", "card")


def entities(text: Column) -> Column:
    return F.when(text.rlike(HINT), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.expr("cast(array() as array<string>)"))


def kind(entity: Column) -> Column:
    out = F.lit("name")
    for name, pattern in reversed([(n, p) for n, p in PATTERNS.items() if n != "name"]):
        out = F.when(entity.rlike(f"^(?:{pattern})$"), F.lit(name)).otherwise(out)
    return out


def keyed(key: str, *parts: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), *parts), 256)


def number(hexed: Column, digits: int = 12) -> Column:
    return F.conv(F.substring(hexed, 1, digits), 16, 10).cast("bigint")


def feistel(df: DataFrame, source: str, target: str, key: str, base: int = 10, rounds: int = 6) -> DataFrame:
    """target: the keyed permutation of the digit strings in source, over strings of the same length."""
    n = F.length(source)
    df = df.withColumn("_a", F.substring(source, F.lit(1), F.floor(n / 2).cast("int"))).withColumn("_b", F.substring(source, (F.floor(n / 2) + 1).cast("int"), n))
    for r in range(rounds):
        one, other = ("_a", "_b") if r % 2 == 0 else ("_b", "_a")
        size = F.length(one)
        value = F.pmod(F.conv(F.col(one), base, 10).cast("bigint") + number(keyed(key, F.col("type"), n.cast("string"), F.lit(str(r)), F.col(other))), F.pow(F.lit(base), size).cast("bigint"))
        df = df.withColumn(one, F.lpad(F.lower(F.conv(value.cast("string"), 10, base)), size, "0"))
    return df.withColumn(target, F.concat("_a", "_b")).drop("_a", "_b")


def luhn(prefix: Column) -> Column:
    """Check digit of a string of digits."""
    n = F.length(prefix)
    doubled = lambda d: F.when(d > 4, 2 * d - 9).otherwise(2 * d)
    total = F.aggregate(F.sequence(F.lit(1), n), F.lit(0), lambda s, i: s + F.when((n - i) % 2 == 0, doubled(F.substr(prefix, i, F.lit(1)).cast("int"))).otherwise(F.substr(prefix, i, F.lit(1)).cast("int")))
    return F.pmod(10 - F.pmod(total, F.lit(10)), F.lit(10))


def laid_out(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in order."""
    return F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("i")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], F.substr(digits, s["i"], F.lit(1))).alias("out"), (s["i"] + 1).alias("i")))
        .otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["i"].alias("i"))), lambda s: s["out"])


def numbers(df: DataFrame, key: str) -> DataFrame:
    """Adds `next` for the number types, from `last` (the surrogate so far, or the entity)."""
    digits = F.regexp_replace("last", "[^0-9]", "")
    octets = F.transform(F.split("last", r"\."), lambda o: F.lpad(F.hex(o.cast("bigint")), 2, "0"))
    # a phone number keeps its country code
    country = F.regexp_extract("last", r"^(\+\d{1,3}(?=[ (-])[ -]?)", 1)
    rest = F.substr("last", F.length(country) + 1)
    plain = F.when(F.col("type") == "ip", F.lower(F.array_join(octets, ""))).when(F.col("type") == "card", F.substr(digits, F.lit(1), F.length(digits) - 1)).when(
        F.col("type") == "phone", F.regexp_replace(rest, "[^0-9]", "")).otherwise(digits)
    df = df.withColumn("_plain", plain)
    ip, other = df.where("type = 'ip'"), df.where("type <> 'ip'")
    ip = feistel(ip, "_plain", "_new", key, base=16)
    octet = lambda i: F.conv(F.substring("_new", i, 2), 16, 10)
    ip = ip.withColumn("next", F.concat_ws(".", octet(1), octet(3), octet(5), octet(7)))
    other = feistel(other, "_plain", "_new", key)
    card = F.concat(F.col("_new"), F.pmod(luhn(F.col("_new")) + F.substr(digits, F.length(digits)).cast("int") - luhn(F.col("_plain")), F.lit(10)).cast("string"))
    other = other.withColumn("next", F.when(F.col("type") == "card", laid_out(F.col("last"), card)).when(
        F.col("type") == "phone", F.concat(country, laid_out(rest, F.col("_new")))).otherwise(laid_out(F.col("last"), F.col("_new"))))
    return ip.unionByName(other).drop("_plain", "_new")


def shaped(text: Column, hexed: Column) -> Column:
    """text with letters and digits replaced by those that the hash gives, other characters kept."""
    byte = lambda i: F.conv(F.substr(hexed, F.pmod(i * 2, F.lit(64)) + 1, F.lit(2)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7
    letter = lambda i, first: F.chr((F.pmod(byte(i), F.lit(26)) + first).cast("bigint"))
    return F.array_join(F.transform(F.split(text, ""), lambda c, i: F.when(c.rlike("[0-9]"), F.pmod(byte(i), F.lit(10)).cast("string"))
                                    .when(c.rlike("[a-z]"), letter(i, 97)).when(c.rlike("[A-Z]"), letter(i, 65)).otherwise(c)), "")


def pick(choices: tuple[str, ...], hexed: Column, at: int) -> Column:
    return F.get(F.array(*[F.lit(c) for c in choices]), F.pmod(F.conv(F.substring(hexed, at, 6), 16, 10).cast("int"), F.lit(len(choices))))


def drawn(df: DataFrame, key: str) -> DataFrame:
    """Adds `next` for the other types, from the entity and the number of draws so far."""
    e, h = F.col("entity"), keyed(key, F.col("type"), F.col("entity"), F.col("draw").cast("string"))
    tail = F.when(F.col("draw") < 3, F.lit("")).otherwise(F.substring(h, 40, 8))
    local, domain = F.substring_index(e, "@", 1), F.substring_index(e, "@", -1)
    email = F.concat(shaped(local, h), tail, F.lit("@"), domain)
    hexes = F.substr(F.concat(h, F.sha2(h, 256)), F.lit(1), F.length(e) + F.when(F.col("draw") < 3, 0).otherwise(8))
    # in the case of the original; of mixed case, place by place
    hexes = F.when(e == F.lower(e), hexes).when(e == F.upper(e), F.upper(hexes)).otherwise(F.array_join(F.transform(
        F.split(hexes, ""), lambda c, i: F.when(F.substr(e, i + 1, F.lit(1)).rlike("[A-F]"), F.upper(c)).otherwise(c)), ""))
    iban = F.concat(F.substring(e, 1, 2), shaped(F.substr(e, F.lit(3)), h), F.upper(tail))
    title = F.regexp_extract(e, rf"^((?:{_TITLES})\.?) ", 1)
    given = F.substr(e, F.length(title) + 2)
    male = title.rlike("^(?:" + "|".join(HONORIFICS["male"]) + r")\.?$")
    female = title.rlike("^(?:" + "|".join(HONORIFICS["female"]) + r")\.?$") | (~male & (F.pmod(number(h, 4), F.lit(2)) == 0))
    cyrillic = given.rlike(r"\p{IsCyrillic}")
    first = F.when(cyrillic & female, pick(NAMES["cyrillic", "female"], h, 5)).when(cyrillic, pick(NAMES["cyrillic", "male"], h, 5)).when(
        female, pick(NAMES["latin", "female"], h, 5)).otherwise(pick(NAMES["latin", "male"], h, 5))
    last = F.when(cyrillic, pick(SURNAMES["cyrillic"], h, 11)).otherwise(pick(SURNAMES["latin"], h, 11))
    more = F.when(F.col("draw") < 3, F.lit("")).otherwise(F.concat(F.lit("-"), F.initcap(F.translate(F.substring(h, 20, 8), "0123456789", "ghijklmnop"))))
    name = F.concat(F.when(F.size(F.split(given, " ")) > 1, F.concat(first, F.lit(" "), last)).otherwise(last), more)
    name = F.concat(title, F.lit(" "), F.when((F.upper(given) == given) & (F.length(given) > 1), F.upper(name)).otherwise(name))
    return df.withColumn("next", F.when(F.col("type") == "email", email).when(F.col("type") == "secret", hexes).when(F.col("type") == "iban", iban).otherwise(name))


def surrogate_table(found: DataFrame, key: str = KEY) -> DataFrame:
    """entity, type, surrogate for distinct entities (entity); the surrogates are distinct and new."""
    base = written(found.select("entity").distinct().withColumn("type", kind(F.col("entity"))), "pii-entities")
    todo = base.select("entity", "type", F.col("entity").alias("last"), F.lit(0).alias("draw"))
    done = None
    originals = base.select(F.col("entity").alias("taken"))
    while True:
        is_number = F.col("type").isin(*NUMBERS)
        tried = numbers(todo.where(is_number), key).unionByName(drawn(todo.where(~is_number), key))
        tried = written(tried.select("entity", "type", "draw", F.col("next").alias("surrogate")), "pii-draws")
        taken = originals if done is None else originals.union(done.select(F.col("surrogate").alias("taken")))
        clash = tried.join(taken, tried["surrogate"] == taken["taken"], "left_semi").select("surrogate").distinct().withColumn("used", F.lit(True))
        keepers = tried.groupBy("surrogate").agg(F.min("entity").alias("keeper")).join(clash, "surrogate", "left").select("surrogate", F.when(F.col("used").isNull(), F.col("keeper")).alias("keeper"))
        marked = written(tried.join(keepers, "surrogate").withColumn("ok", F.coalesce(F.col("keeper") == F.col("entity"), F.lit(False))), "pii-checked")
        good = marked.where("ok").select("entity", "type", "surrogate")
        done = good if done is None else done.union(good)
        todo = marked.where("not ok").select("entity", "type", F.col("surrogate").alias("last"), (F.col("draw") + 1).alias("draw"))
        if todo.isEmpty():
            return done


def pseudonymised(docs: DataFrame, key: str = KEY) -> DataFrame:
    """docs with surrogates in `text` and a column `n_entities` behind (replacing one of that name).

    All other columns stay. Null texts stay null with 0 entities; rows with equal text get equal texts.
    """
    columns = [c for c in docs.columns if c != "n_entities"]
    e = entities(F.col("text"))
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "text")
    hit = rows.withColumn("entities", e).where(F.size("entities") > 0)
    clean = rows.where(F.col("text").isNull() | (F.size(e) == 0))
    pairs = written(hit.select(F.sha2("text", 256).alias("id"), F.explode(F.array_distinct("entities")).alias("entity")).distinct(), "pii-mentions")
    mapping = written(surrogate_table(pairs, key), "pii-surrogates")
    maps = pairs.join(mapping, "entity").groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("entity", "surrogate"))).alias("map"))
    maps = written(maps, "pii-maps")  # a document's own entities
    replaced = hit.withColumn("id", F.sha2("text", 256)).join(maps, "id")
    parts = F.zip_with(F.split("text", PATTERN, -1), F.transform("entities", lambda x: F.element_at("map", x)), lambda p, s: F.concat(p, F.coalesce(s, F.lit(""))))
    out = lambda text, n: [text if c == "text" else F.col("row")[c].alias(c) for c in columns] + [n]
    return clean.select(*out(F.col("text"), F.lit(0).cast("bigint").alias("n_entities"))).union(
        replaced.select(*out(F.array_join(parts, "").alias("text"), F.size("entities").cast("bigint").alias("n_entities"))))


def op7_keyed_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymised(table(spark, sf_dir, "documents").select("doc_id", "text"))
