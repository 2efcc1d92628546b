"""PII surrogates: keyed replacements of the same type, format, script and gender, checked for collisions.

Everything here is DataFrame functions; no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from siftline.llm.common import numbered, written

#: The default key; a caller passes a secret one.
KEY = "siftline"
#: Times that colliding surrogates are drawn anew in their format, and times more in a wider one.
ROUNDS, WIDER = 12, 8
#: What stands around a mention while a text is cut, and what stands for its first character in a text that has it itself.
MARK, PLAIN, ESCAPED = "\ufdd0\ufdd1", "\ufdd0", "\ufdd0\ufdd2"

# Titles before a name, with the gender they tell (m, f, or u for neither).
TITLES = {
    "m": ["Mr", "Herr", "Monsieur", "Señor", "Sr", "Don", "Sir", "г-н", "господин", "κύριος"],
    "f": ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Doña", "Lady", "г-жа", "госпожа", "κυρία"],
    "u": ["Dr", "Prof", "Mx"],
}
# Given names by script and gender that surrogates begin with.
GIVEN = {
    "latin_m": ["Adam", "Albert", "Anton", "Bruno", "Carl", "Daniel", "David", "Emil", "Felix", "Hugo", "Ivan", "Jonas", "Leo", "Lucas", "Martin", "Nicolas", "Oscar", "Paul", "Simon", "Victor"],
    "latin_f": ["Ada", "Alice", "Anna", "Bella", "Clara", "Diana", "Elena", "Emma", "Eva", "Flora", "Helena", "Ida", "Julia", "Laura", "Lina", "Maria", "Nora", "Rosa", "Sara", "Vera"],
    "cyrillic_m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл", "Лев", "Максим"],
    "cyrillic_f": ["Алла", "Анна", "Вера", "Дарья", "Елена", "Инна", "Лидия", "Мария", "Нина", "Ольга"],
    "greek_m": ["Άρης", "Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος", "Χρήστος"],
    "greek_f": ["Άννα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία", "Χριστίνα"],
}
# Further given names that tell a name and its gender where no title does.
FREQUENT = {
    "m": ["Alexander", "Andrew", "Carlos", "Charles", "Edward", "Frank", "George", "Hans", "Henry", "Jack", "James", "Jean", "John", "José", "Juan", "Klaus", "Luis", "Mark", "Michael", "Peter", "Pierre", "Robert", "Stefan", "Thomas", "William"],
    "f": ["Barbara", "Carmen", "Catherine", "Charlotte", "Elizabeth", "Emily", "Grace", "Hannah", "Isabel", "Jane", "Jennifer", "Karen", "Linda", "Lucy", "Margaret", "Marie", "Mary", "Olivia", "Patricia", "Sarah", "Sofia", "Sophie", "Susan", "Teresa", "Ursula"],
}
# Consonants and vowels that family names are made of, by script.
SYLLABLES = {"latin": ("bdfgklmnprstv", "aeiou"), "cyrillic": ("бвгдзклмнпрст", "аеиоу"), "greek": ("βγδζκλμνπρστ", "αεηιο")}
# Alphabets that letters are drawn from, by script.
ALPHABETS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщъыьэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

#: Gender by given name, in lower case.
GIVEN_GENDER = {name.lower(): group[-1] for group, names in (GIVEN | FREQUENT).items() for name in names}


def _alternatives(words: list[str]) -> str:
    """A pattern of the words that looks at the first letter once."""
    heads = sorted({w[0] for w in words})
    return "|".join(f"{h}(?:{'|'.join(sorted((w[1:] for w in set(words) if w[0] == h), key=lambda x: (-len(x), x)))})" for h in heads)


_TITLE = "|".join(sorted((t for group in TITLES.values() for t in group), key=len, reverse=True))
_TITLE_START = "".join(sorted({t[0] for group in TITLES.values() for t in group}))
_NAME = r"\p{Lu}[\p{L}'’-]++"
_GIVEN = _alternatives([n for names in (GIVEN | FREQUENT).values() for n in names])
_GIVEN_START = "".join(sorted({n[0] for names in (GIVEN | FREQUENT).values() for n in names}))
_LABEL = r"(?i:password|passwd|secret|api_key|token)\s?[=:]\s?[\"']?"
#: What a mention may begin with and keeps: a title and space, or a label.
_PREFIX = rf"^(?:(?:{_TITLE})\.?\s(?=\p{{Lu}})|{_LABEL})"

#: Types in the order in which they are tried at a position, and their patterns. Each can fail at the first character or two.
PATTERNS = {
    "email": r"(?<![\w.+-])[\w.+-]++@[\p{L}0-9-]+(?:\.[\p{L}0-9-]+)*\.\p{L}{2,}",
    "labelled secret": rf"(?=[pPsSaAtT])(?<![A-Za-z0-9]){_LABEL}[^\s\"',;|#$%&*]{{8,}}",
    "secret": r"(?=[A-Za-z0-9])(?<![A-Za-z0-9])(?:AKIA[0-9A-Z]{16}|[0-9a-f]{32,128}|gh[pousr]_[A-Za-z0-9]{20,}|sk-[A-Za-z0-9]{20,})(?![A-Za-z0-9])",
    "iban": r"(?=[A-Z])(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ip": r"(?=\d)(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)\.){3}(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)(?!\.?\d)",
    "card": r"(?=[2-6])(?<![\d.])[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\.?\d)",
    "ssn": r"(?=\d)(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?=[+(\d])(?:(?<![\d+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?\d{3,4}[ .-]?\d{3,4}|\d{2,4}[ .-]\d{3,4}[ .-]\d{3,4})(?![\d-])|(?<![\d+])\+\d{8,15}(?!\d))",
    "person": rf"(?=[{_TITLE_START}])(?<!\p{{L}})(?:{_TITLE})\.?\s{_NAME}(?:\s{_NAME}){{0,2}}",
    "named person": rf"(?=[{_GIVEN_START}])(?<!\p{{L}})(?:{_GIVEN})(?:\s{_NAME}){{1,2}}",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())


def _type_of(prefix: Column, core: Column) -> Column:
    """The type of what ANY has found; null for a number like a card's whose Luhn sum is wrong, which is no entity."""
    checks = {"email": r"^[^@\s]+@[^@\s]+$", "ip": r"^\d{1,3}(?:\.\d{1,3}){3}$", "ssn": r"^\d{3}-\d{2}-\d{4}$", "iban": r"^[A-Z]{2}\d{2}[A-Z0-9 ]{11,}$", "card": r"^[2-6]\d{3}(?:[ -]?\d{4}){2}[ -]?\d{1,7}$", "phone": r"^[+(\d][\d ().-]+$"}
    out = F.when(prefix.rlike(f"^{_LABEL}$") | core.rlike("^AKIA[0-9A-Z]{16}$"), "secret").when((prefix != "") | core.rlike(rf"^(?:{_GIVEN})\s{_NAME}"), "person")
    for kind, pattern in checks.items():
        named = F.lit(kind) if kind != "card" else F.when(_luhn_sum(F.regexp_replace(core, r"\D", "")) % 10 == 0, kind)
        out = out.when(core.rlike(pattern), named)
    return out.otherwise("secret")


def _canonical(kind: Column, entity: Column) -> Column:
    """What makes two mentions the same: digits of numbers, letters and digits of accounts, lower case of the rest but secrets."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(entity, r"\D", "")).when(kind == "iban", F.regexp_replace(entity, r"\s", "")).when(kind == "secret", entity).otherwise(F.lower(F.regexp_replace(entity, r"\s+", " ")))


def _bytes_at(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (2 * i + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), (n % len(letters) + 1).cast("int"), F.lit(1))


def _stream(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    """Keyed hexadecimal digits, two for each character of canon and 32 more."""
    seed = F.sha2(F.concat_ws("\u0001", F.lit(key), kind, canon, attempt.cast("string")), 256)
    parts = F.transform(F.sequence(F.lit(0), F.floor(F.length(canon) / 32).cast("int") + 1), lambda k: F.sha2(F.concat(F.lit(key), seed, k.cast("string")), 256))
    return F.array_join(parts, "")


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _by_class(canon: Column, stream: Column, hexadecimal: Column, from_end: Column, kept: Column) -> Column:
    """canon with each digit and letter replaced by one of its kind; the first `kept` and last `from_end` characters stay."""

    def one(i: Column) -> Column:
        c, n = F.substring(canon, (i + 1).cast("int"), F.lit(1)), _bytes_at(stream, i)
        n = n * 256 + _bytes_at(stream, i + 1)
        low = F.lower(c)
        drawn = F.when(hexadecimal & c.rlike("[0-9a-f]"), _pick("0123456789abcdef", n))
        drawn = drawn.when(c.rlike("[1-9]") & (i == 0), _pick("123456789", n)).when(c.rlike("[0-9]"), _pick("0123456789", n))
        for script, pattern in (("cyrillic", r"\p{IsCyrillic}"), ("greek", r"\p{IsGreek}"), ("latin", r"\p{L}")):
            drawn = drawn.when(low.rlike(pattern), F.when(c == low, _pick(ALPHABETS[script], n)).otherwise(F.upper(_pick(ALPHABETS[script], n))))
        return F.when((i < kept) | (i >= F.length(canon) - from_end), c).otherwise(F.coalesce(drawn, c))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.greatest(F.length(canon) - 1, F.lit(0))), one), "")


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of digits, the last one not doubled."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: F.substring(digits, i.cast("int"), F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1))
    return F.aggregate(each, F.lit(0), lambda s, x: s + F.when(x > 9, x - 9).otherwise(x))


def _check_digits(account: Column, country: Column) -> Column:
    """The two digits that make an account number's remainder by 97 one; letters count as 10 to 35."""
    text = F.concat(account, country, F.lit("00"))

    def step(rest: Column, i: Column) -> Column:
        c = F.ascii(F.substring(text, i.cast("int"), F.lit(1)))
        return F.when(c >= 65, (rest * 100 + c - 55) % 97).otherwise((rest * 10 + c - 48) % 97)

    return F.lpad((98 - F.aggregate(F.sequence(F.lit(1), F.length(text)), F.lit(0), step)).cast("string"), 2, "0")


def _surrogate(wider: int = 0) -> Column:
    """Surrogate of the columns kind, canon, gender, stream. With `wider` above 0 it has more values than its format: more digits, letters or
    syllables, and any octets."""
    kind, canon, stream = F.col("kind"), F.col("canon"), F.col("stream")
    none = F.lit(0)
    more = F.substring(stream, 97, 2 * wider)
    more_digits, more_letters = F.translate(more, "abcdef", "012345"), F.translate(more, "0123456789", "ghijklmnop")
    domain = F.length(F.substring_index(canon, ".", -1)) + 1
    octets = F.transform(F.split(canon, r"\."), lambda o, i: (_bytes_at(stream, i) % 254 + 1).cast("string") if wider else F.when(F.length(o) == 1, _bytes_at(stream, i) % 9 + 1).when(F.length(o) == 2, _bytes_at(stream, i) % 90 + 10).otherwise(_bytes_at(stream, i) % 156 + 100).cast("string"))
    drawn = _by_class(canon, stream, F.lit(False), none, F.when(kind == "card", 1).otherwise(0))
    body = F.concat(F.substring(drawn, F.lit(1), F.length(drawn) - 1), more_digits)
    check = (10 - _luhn_sum(F.concat(body, F.lit("0"))) % 10) % 10
    card = F.concat(body, check.cast("string"))
    script = _script(canon)
    gender = F.when(F.col("gender") == "u", F.when(_bytes_at(stream, F.lit(30)) % 2 == 0, "m").otherwise("f")).otherwise(F.col("gender"))
    given = F.lit(None).cast("string")
    for name, names in GIVEN.items():
        given = F.when(F.concat_ws("_", script, gender) == name, F.element_at(F.array(*map(F.lit, names)), (_bytes_at(stream, F.lit(29)) % len(names) + 1).cast("int"))).otherwise(given)
    family = F.lit(None).cast("string")
    for name, (hard, soft) in SYLLABLES.items():
        made = F.initcap(F.concat(*[x for k in range(4) for x in (_pick(hard, _bytes_at(stream, F.lit(2 * k))), _pick(soft, _bytes_at(stream, F.lit(2 * k + 1))))]))
        made = F.concat(made, *[x for k in range(4, 4 + wider) for x in (_pick(hard, _bytes_at(stream, F.lit(2 * k))), _pick(soft, _bytes_at(stream, F.lit(2 * k + 1))))])
        family = F.when(script == name, made).otherwise(family)
    words = F.size(F.split(canon, " "))
    person = F.when(words == 1, family).when(words == 2, F.concat_ws(" ", given, family)).otherwise(F.concat_ws(" ", given, F.concat(_upper_initial(family), F.lit(".")), family))
    secret = F.when(canon.rlike("^AKIA"), _by_class(canon, stream, F.lit(False), none, F.lit(4))).when(canon.rlike("^[0-9a-f]+$"), _by_class(canon, stream, F.lit(True), none, none)).otherwise(drawn)
    email, country = _by_class(canon, stream, F.lit(False), domain, none), F.substring(canon, 1, 2)
    account = F.concat(F.substring(drawn, F.lit(5), F.length(drawn)), more_digits)
    return (
        F.when(kind == "email", F.concat(F.substring_index(email, "@", 1), more_letters, F.lit("@"), F.substring_index(email, "@", -1)))
        .when(kind == "ip", F.array_join(octets, "."))
        .when(kind == "card", card)
        .when(kind == "iban", F.concat(country, _check_digits(account, country), account))
        .when(kind == "person", person)
        .when(kind == "secret", F.concat(secret, more))
        .otherwise(F.concat(drawn, more_digits))
    )


def _upper_initial(text: Column) -> Column:
    return F.upper(F.substring(text, 1, 1))


def draw_surrogates(entities: DataFrame, key: str = KEY, rounds: int = ROUNDS) -> DataFrame:
    """entities(kind, canon, gender), distinct by kind and canon -> (kind, canon, surrogate), distinct by kind and surrogate.

    A surrogate is drawn from a keyed hash. It collides if another entity of its kind has drawn it, or if it is an entity of
    its kind itself; both are compared as entities are, so the case of secrets counts and that of names doesn't. Of those that drew the
    same one the smallest stays, the others draw again. What still collides after `rounds` (a format with hardly more values than
    entities) draws WIDER times more from ever more values, under the same check: distinctness goes before format. An error if
    that isn't enough.
    """
    todo = entities.withColumn("attempt", F.lit(0))
    real = entities.select("kind", F.col("canon").alias("drawn"))
    done = None
    for k in range(rounds + WIDER):
        drawn = todo.withColumn("stream", _stream(key, F.col("kind"), F.col("canon"), F.col("attempt"))).withColumn("surrogate", _surrogate(max(0, k + 1 - rounds))).drop("stream")
        drawn = written(drawn.withColumn("drawn", _canonical(F.col("kind"), F.col("surrogate"))), f"drawn{k}")
        taken = real if done is None else real.unionByName(done.select("kind", _canonical(F.col("kind"), F.col("surrogate")).alias("drawn")))
        first = drawn.groupBy("kind", "drawn").agg(F.min("canon").alias("canon"))
        good = first.join(taken, ["kind", "drawn"], "left_anti")
        settled = written(drawn.join(good, ["kind", "drawn", "canon"]).select("kind", "canon", "surrogate"), f"settled{k}")
        done = settled if done is None else done.unionByName(settled)
        todo = written(drawn.join(settled.select("kind", "canon"), ["kind", "canon"], "left_anti").select("kind", "canon", "gender", (F.col("attempt") + 1).alias("attempt")), f"colliding{k}")
        if not todo.limit(1).count():
            return done
    raise RuntimeError(f"surrogates still collide after {rounds + WIDER} draws")


def _render(kind: Column, entity: Column, surrogate: Column) -> Column:
    """The surrogate in the format of a mention: numbers and accounts get the mention's separators, and all-capital mentions capitals."""

    def place(kept: str) -> Column:
        plain = F.regexp_replace(surrogate, kept, "")
        at = F.transform(F.sequence(F.lit(1), F.length(entity)), lambda i: F.struct(F.substring(entity, i.cast("int"), F.lit(1)).alias("c"), F.length(F.regexp_replace(F.substring(entity, F.lit(1), i.cast("int")), kept, "")).alias("n")))
        return F.concat(F.array_join(F.transform(at, lambda x: F.when(x["c"].rlike(kept), x["c"]).otherwise(F.substring(plain, x["n"].cast("int"), F.lit(1)))), ""), F.substring(plain, F.length(F.regexp_replace(entity, kept, "")) + 1, F.length(plain)))

    other = F.when((F.upper(entity) == entity) & (F.lower(entity) != entity) & (kind != "secret"), F.upper(surrogate)).otherwise(surrogate)
    return F.when(kind.isin("phone", "card", "ssn"), place("[^0-9]")).when(kind == "iban", place(r"\s")).otherwise(other)


def _gender(prefix: Column, entity: Column) -> Column:
    """Gender told by the title that a mention begins with, else by its given name."""
    title, given = F.regexp_replace(F.lower(prefix), r"\.?\s$", ""), F.lower(F.substring_index(entity, " ", 1))
    by_name = F.create_map(*[F.lit(x) for pair in GIVEN_GENDER.items() for x in pair])[given]
    return F.when(title.isin([t.lower() for t in TITLES["m"]]), "m").when(title.isin([t.lower() for t in TITLES["f"]]), "f").otherwise(F.coalesce(by_name, F.lit("u")))


def _cut(text: Column) -> Column:
    """The text as an array in which gaps and mentions take turns, beginning and ending with a gap. The one search of the text."""
    return F.split(F.regexp_replace(F.replace(text, F.lit(PLAIN), F.lit(ESCAPED)), ANY, f"{MARK}$0{MARK}"), MARK, -1)


def _uncut(piece: Column) -> Column:
    return F.replace(piece, F.lit(ESCAPED), F.lit(PLAIN))


def replace_entities(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of docs: (<id_col>, <text_col>, n_entities, kinds array<string>), entities replaced by surrogates.

    Mentions of one entity get one surrogate in all documents (coreference), two entities of a kind never the same
    one, and no surrogate is an entity of its kind that occurs. Digits stay digits and letters letters of their script and case; e-mail addresses
    keep their top-level domain, valid card numbers stay valid, octets stay octets, hexadecimal secrets hexadecimal; a name gets
    a given name of the gender that its title tells in any mention (drawn by the key if none does), of
    its script, with as many words. Everything else stays as it was, character for character.

    Names are found behind a title, and without one where they begin with a given name of GIVEN or FREQUENT; account numbers get right
    check digits. `Mr Smith` and `Mr John Smith` are two entities.

    Null text stays null with no entities; repeated rows are treated alike; other columns are not read. Whole texts are searched, once:
    a written table has each text cut at its mentions, and all else works on that. Only
    documents with entities are joined to their replacements; the others are not shuffled.
    """
    held = numbered(docs.select(F.col(id_col).alias("id"), _cut(F.col(text_col)).alias("parts")))
    some = F.coalesce(F.size("parts"), F.lit(0)) > 1
    found = held.where(some).select("rid", F.posexplode("parts").alias("k", "part")).where("k % 2 = 1").select("rid", "k", _uncut(F.col("part")).alias("whole"))
    found = found.withColumn("prefix", F.regexp_extract("whole", _PREFIX, 0)).withColumn("entity", F.expr("substring(whole, length(prefix) + 1)")).withColumn("kind", _type_of(F.col("prefix"), F.col("entity")))
    mentions = written(found.select("rid", "k", "prefix", "entity", "kind", _canonical(F.col("kind"), F.col("entity")).alias("canon"), _gender(F.col("prefix"), F.col("entity")).alias("gender")), "mentions")
    entities = written(mentions.where("kind IS NOT NULL").groupBy("kind", "canon").agg(F.coalesce(F.min(F.when(F.col("gender") != "u", F.col("gender"))), F.lit("u")).alias("gender")), "entities")
    surrogates = written(draw_surrogates(entities, key), "surrogates")
    replaced = mentions.join(surrogates, ["kind", "canon"], "left").withColumn("new", F.concat("prefix", F.coalesce(_render(F.col("kind"), F.col("entity"), F.col("surrogate")), "entity")))
    per_row = written(replaced.groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("k", "new", "kind"))).alias("r")), "replacements")
    changed = held.where(some).join(per_row, "rid")
    pieces = F.transform("parts", lambda p, i: F.when(i % 2 == 0, _uncut(p)).otherwise(F.get("r", ((i - 1) / 2).cast("int"))["new"]))
    kinds = F.filter(F.transform("r", lambda r: r["kind"]), lambda k: k.isNotNull())
    changed = changed.select(F.col("id").alias(id_col), F.array_join(pieces, "").alias(text_col), F.size(kinds).cast("long").alias("n_entities"), F.array_sort(F.array_distinct(kinds)).alias("kinds"))
    same = held.where(~some).select(F.col("id").alias(id_col), _uncut(F.get("parts", F.lit(0))).alias(text_col), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("kinds"))
    return changed.unionByName(same)


def op1_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replace_entities(spark.read.parquet(f"{sf_dir}/documents.parquet"))
