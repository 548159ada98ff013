"""Surrogates for personal data, by DataFrame functions alone.

One pattern finds all entities of a text. An entity has a kind and a canonical form (digits of a phone number, lower-case address, name token); equal
canonical forms get the same surrogate everywhere, whatever their punctuation or case, so references stay together. A surrogate is drawn by a
keyed digest, character by character: digits for digits, letters for letters, hexadecimal for hexadecimal; it keeps separators, a card's first digit and
check digit, an address's top domain (equal domains get equal surrogates), a number's leading digit. Name tokens get a name of the same gender
(from the name or the title before it), script and case.

Collisions: the surrogates of all different entities of the corpus are compared with one another and with all originals; of those that share one the
smallest keeps it, and no surrogate may equal an original. The others are drawn again; after a few rounds the rest is ranked within its format and gets the free surrogates of that format by rank,
and if there are too few, those of a format with one place more. So different entities stay different however full a format is.

Plan: entities are taken from different texts once, so a text that a third of the rows share is looked at once after its digest has been
combined; entities, mapping and occurrences are narrow tables and joined with stored tables on both sides, where Spark splits hot keys. Only texts with
entities are shuffled, by their digest, to meet their surrogates; all others stay where they are.

Null and empty texts and texts without entities come back unchanged. Rows with a null or repeated id are treated by their text alone. Ties cannot occur:
the smallest canonical form wins. All columns come back in order. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.llm.common import ranked, unused
from ledgerlens.session import materialize

_RUN = r"\p{L}\p{N}._%+\-"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_TITLES_F = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Señorita", "Srta", "Signora", "Госпожа")
_TITLES_M = ("Mr", "Herrn", "Herr", "Monsieur", "Señor", "Sr", "Signor", "Господин")
_TITLES_U = ("Dr", "Prof", "Rev")
#: Given names that are known as such without a title; fixed values.
GIVEN_F = ("Alice", "Anna", "Barbara", "Carmen", "Claire", "Elena", "Elizabeth", "Emma", "Ingrid", "Isabel", "Jennifer", "Julia", "Karen", "Laura",
           "Linda", "Lucía", "Maria", "Marie", "Mary", "Monika", "Patricia", "Sabine", "Sarah", "Sophie", "Susan", "Ursula", "Анна", "Елена",
           "Мария", "Ольга")
GIVEN_M = ("Antonio", "Carlos", "Charles", "David", "François", "Hans", "James", "Javier", "Jean", "John", "Jürgen", "Karl", "Klaus", "Luis", "Manuel",
           "Michael", "Michel", "Miguel", "Paul", "Peter", "Philippe", "Pierre", "Robert", "Stefan", "Thomas", "William", "Алексей",
           "Дмитрий", "Иван", "Сергей")
_TITLE = "|".join((*_TITLES_F, *_TITLES_M, *_TITLES_U))
_GIVEN = "|".join((*GIVEN_F, *GIVEN_M))
_NAME = r"\p{Lu}[\p{L}'’\-]*[\p{L}]"

#: Kinds in the order in which they are tried.
KINDS = {
    "email": rf"(?<![{_RUN}])[{_RUN}]++@[\p{{L}}\p{{N}}\-][\p{{L}}\p{{N}}.\-]*(?<!\.)\.\p{{L}}{{2,24}}(?![\p{{L}}\p{{N}}])",
    "key": r"(?<![A-Za-z0-9])(?:AKIA|ASIA)[A-Z0-9]{16}(?![A-Za-z0-9])",
    "token": r"(?<![A-Za-z0-9])(?:ghp_|gho_|xoxb-|xoxp-|sk-)[A-Za-z0-9_\-]{16,}",
    "hex": r"(?<![A-Za-z0-9])(?=[a-f]*[0-9])(?=[0-9]*[a-f])[0-9a-f]{32,}+(?![A-Za-z0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ipv6": r"(?<![\w:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![\w:])",
    "ip": rf"(?<![\d.A-Za-z]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)",
    "card": r"(?<![\d.A-Za-z+])[3-6]\d{3}(?:[ \-]?\d{4}){2}[ \-]?\d{1,7}(?!\d)|(?<![\d.A-Za-z+])3\d{3}[ \-]\d{6}[ \-]\d{5}(?!\d)",
    "ssn": r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])",
    "phone": r"(?<![\w+])\+?\d{1,3}[ .\-]?\(\d{2,4}\)[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)"
             r"|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,4}(?!\d)|(?<![\w+])\(\d{3}\) ?\d{3}[ .\-]\d{4}(?!\d)"
             r"|(?<![\w+.\-])\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])",
    "name": rf"(?=\p{{Lu}})(?<![\p{{L}}])(?<=(?<!\p{{L}})(?:{_TITLE})\.? )(?!(?:{_TITLE})(?!\p{{L}})){_NAME}"
            rf"|(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_TITLE})\.? \p{{Lu}}[\p{{L}}'’\-]{{1,30}} ){_NAME}"
            rf"|(?=\p{{Lu}})(?<=(?<!\p{{L}})(?:{_GIVEN}) ){_NAME}"
            rf"|(?=\p{{Lu}})(?<!\p{{L}})(?:{_GIVEN})(?= \p{{Lu}}\p{{L}})",
}
#: All kinds in one pattern. None but a social security number begins right after an ASCII letter, so inside words little is tried. Only single characters
#: are repeated without a bound, which the matcher does in a loop, so a text of any kind and length needs no deep stack.
EVERY = rf"(?<![A-Za-z])(?:{'|'.join(v for k, v in KINDS.items() if k != 'ssn')})|(?=\d){KINDS['ssn']}"
#: Characters that mark the entities of a text while it is taken apart; they stand for nothing in Unicode.
_OPEN, _CLOSE = "\ufdd0", "\ufdd1"
#: What a text with an entity must have; cheap to look for.
MAYBE = rf"[0-9@]|AKIA|ASIA|ghp_|gho_|xoxb-|xoxp-|sk-|[A-Fa-f]:[A-Fa-f]|(?=\p{{Lu}})(?<!\p{{L}})(?:{_TITLE}|{_GIVEN})[. ]"
_SYLLABLES = {
    "latin": ("ba", "be", "bo", "da", "do", "fa", "fe", "ga", "go", "ha", "jo", "ka", "ke", "la", "le", "li", "lo", "ma", "me", "mi", "mo", "na", "ne",
              "ni", "no", "ra", "re", "ri", "ro", "sa", "se", "so"),
    "cyrillic": ("ба", "бе", "бо", "ва", "ве", "га", "го", "да", "де", "до", "жа", "за", "зо", "ка", "ко", "ла", "ле", "ли", "ло", "ма", "ме", "ми",
                 "мо", "на", "не", "но", "ра", "ре", "ро", "са", "се", "то"),
}
_ENDINGS = {("latin", "f"): "lia", ("latin", "m"): "rus", ("latin", "u"): "ner", ("cyrillic", "f"): "ина", ("cyrillic", "m"): "ан", ("cyrillic", "u"): "енко"}


def _pieces(text: Column) -> Column:
    """The text cut at its entities: what is before the first, the first, what is between it and the second and so on, one search for all."""
    marked = F.split(F.regexp_replace(text, EVERY, f"{_OPEN}$0{_CLOSE}"), f"[{_OPEN}{_CLOSE}]", -1)
    found, rest = F.regexp_extract_all(text, F.lit(EVERY), F.lit(0)), F.split(text, EVERY, -1)
    both = F.slice(F.flatten(F.zip_with(rest, found, lambda r, e: F.array(r, F.coalesce(e, F.lit(""))))), F.lit(1), F.size(rest) + F.size(found))
    return F.when(text.rlike(f"[{_OPEN}{_CLOSE}]"), both).otherwise(marked)  # a text with such characters is searched twice


def _entities(pieces: Column) -> Column:
    """All entities in order, each with the words before it and whether the next one follows after a blank."""
    # the array is worked out once and zipped with itself: inside a lambda it would be worked out for every entity
    zipped = F.arrays_zip(F.slice(pieces, F.lit(1), F.size(pieces)), F.slice(pieces, F.lit(2), F.size(pieces)), F.slice(pieces, F.lit(3), F.size(pieces)))
    every = F.transform(zipped, lambda x, i: F.struct(x["1"].alias("e"), F.substring(x["0"], -14, 14).alias("before"), (x["2"] == " ").alias("joined"), i.alias("i")))
    return F.filter(every, lambda x: (x["i"] % 2 == 0) & x["e"].isNotNull())


def _kind(e: Column, before: Column, joined: Column) -> Column:
    """The kind; name tokens are ``given_f``, ``given_m``, ``given_u`` or ``surname``."""
    kind = F.lit(None).cast("string")
    title = F.regexp_extract(before, rf"(?:^|[^\p{{L}}])({_TITLE})\.? $", 1)
    gender = F.when(title.isin(*_TITLES_F), "f").when(title.isin(*_TITLES_M), "m").otherwise("u")
    name = (F.when(e.isin(*GIVEN_F), "given_f").when(e.isin(*GIVEN_M), "given_m")
            .when((title != "") & joined, F.concat(F.lit("given_"), gender)).otherwise("surname"))
    for k in reversed([k for k in KINDS if k != "name"]):
        kind = F.when(e.rlike(f"^(?:{KINDS[k]})$"), k).otherwise(kind)
    return F.coalesce(kind, name)


def _canonical(kind: Column, e: Column) -> Column:
    """Form in which equal entities are equal."""
    return (F.when(kind.isin("card", "phone", "ssn"), F.regexp_replace(e, r"\D", ""))
            .when(kind == "iban", F.regexp_replace(e, " ", "")).when(kind.isin("key", "token"), e).otherwise(F.lower(e)))


def _digest(key: str, *parts: Column) -> Column:
    """256 keyed bytes in hexadecimal."""
    seed = F.sha2(F.concat_ws("\x1f", F.lit(key), *parts).cast("binary"), 512)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}{i}"), seed).cast("binary"), 512) for i in range(4)])


def _byte(digest: Column, i: Column) -> Column:
    """Byte number ``i`` (from 0, in a circle) of the digest."""
    return F.conv(F.substring(digest, (i % 256) * 2 + 1, F.lit(2)), 16, 10).cast("int")


#: Letters that stand for those of other scripts: from each first character on so many, in steps.
_SCRIPTS = {name: "".join(chr(first + i * step) for i in range(count)) for name, (first, count, step) in {
    "Cyrillic": (0x430, 32, 1), "Greek": (0x3B1, 17, 1), "Hebrew": (0x5D0, 22, 1), "Arabic": (0x628, 19, 1), "Han": (0x4E09, 64, 7), "Hiragana": (0x304B, 23, 2),
    "Katakana": (0x30AB, 23, 2), "Hangul": (0xAC00, 64, 28), "Devanagari": (0x915, 37, 1), "Thai": (0xE01, 40, 1)}.items()}


def _drawn(value: Column, digest: Column, hexadecimal: bool = False) -> Column:
    """Each character by one of its own class and script; others stay."""
    letters, digits = ("abcdef" if hexadecimal else "abcdefghijklmnopqrstuvwxyz"), "0123456789"

    def one(alphabet: str, i: Column) -> Column:
        return F.substring(F.lit(alphabet), _byte(digest, i) % len(alphabet) + 1, F.lit(1))

    def swap(c: Column, i: Column) -> Column:
        small = one(digits + "abcdef", i) if hexadecimal else one(letters, i)
        return (F.when(c.rlike(r"^\d$"), one(digits + "abcdef", i) if hexadecimal else one(digits, i)).when(c.rlike(r"^\p{Lu}$"), F.upper(small))
                .when(c.rlike(r"^\p{L}$"), small).otherwise(c))

    def swap_any(c: Column, i: Column) -> Column:
        out = swap(c, i)
        for script, alphabet in _SCRIPTS.items():
            other = one(alphabet, i)
            out = F.when(c.rlike(rf"^\p{{Is{script}}}$"), F.when(c.rlike(r"^\p{Lu}$"), F.upper(other)).otherwise(other)).otherwise(out)
        return out

    if hexadecimal:
        return F.array_join(F.transform(F.split(value, ""), swap), "")
    return F.when(value.rlike(r"[^\x00-\u024f]"), F.array_join(F.transform(F.split(value, ""), swap_any), "")).otherwise(
        F.array_join(F.transform(F.split(value, ""), swap), ""))


def _luhn(digits: Column) -> Column:
    """Luhn sum of digits, modulo 10."""
    n = F.length(digits)

    def add(total: Column, x: Column) -> Column:
        d = x["d"] * F.when((n - x["i"]) % 2 == 0, 2).otherwise(1)
        return total + F.when(d > 9, d - 9).otherwise(d)

    return F.aggregate(F.transform(F.split(digits, ""), lambda c, i: F.struct(c.cast("int").alias("d"), i.alias("i"))), F.lit(0), add) % 10


def _mod97(account: Column) -> Column:
    """Remainder of an account number with its country and check digits moved to the end and letters as 10 to 35; 1 if the check digits are right."""
    turned = F.concat(F.substring(account, F.lit(5), F.length(account)), F.substring(account, 1, 4))

    def add(total: Column, c: Column) -> Column:
        return (F.when(c.rlike(r"^\d$"), total * 10 + c.cast("int")).otherwise(total * 100 + F.ascii(c) - 55) % 97).cast("int")

    return F.aggregate(F.split(turned, ""), F.lit(0), add)


def _parts(key: str, kind: Column, value: Column, attempt: Column) -> dict[str, Column]:
    """Digest of an entity and what its surrogate is made of, by kind; some refer to columns that ``_draw`` adds."""
    digest = _digest(key, kind, value, attempt.cast("string"))
    drawn = _drawn(value, digest)
    bank = F.concat(F.substring(value, 1, 2), F.lit("00"), F.expr("substring(_drawn, 5)"))
    iban = F.when(_mod97(value) == 1, F.concat(F.substring(value, 1, 2), F.lpad((98 - _mod97(bank)).cast("string"), 2, "0"), F.expr("substring(_drawn, 5)"))).otherwise(
        F.concat(F.substring(value, 1, 2), F.expr("substring(_drawn, 3)")))
    head_kept = F.concat(F.substring(value, 1, 1), F.expr("substring(_drawn, 2)"))
    body = F.expr("substring(_drawn, 2, length(_drawn) - 2)")
    card = F.concat(F.substring(value, 1, 1), body)
    check = F.when(_luhn(value) == 0, ((10 - _luhn(F.concat(card, F.lit("0")))) % 10).cast("string")).otherwise(F.expr("right(_drawn, 1)"))
    domain = F.substring_index(value, "@", -1)
    top = F.substring_index(domain, ".", -1)
    host = F.expr("substring(_domain, 1, length(_domain) - length(_top) - 1)")
    ip = F.array_join(F.transform(F.split(value, r"\."), lambda c, i: (_byte(digest, i) % 254 + 1).cast("string")), ".")
    gender = F.when(kind.startswith("given_"), F.substring(kind, -1, 1)).otherwise("u")

    def name(script: str) -> Column:
        many = F.array(*[F.lit(s) for s in _SYLLABLES[script]])
        # one more syllable for every third draw, so that names never run out
        count = F.lit(2) + F.floor(attempt / 3).cast("int")
        parts = F.transform(F.sequence(F.lit(0), count - 1), lambda i: F.get(many, _byte(digest, i) % len(_SYLLABLES[script])))
        end = F.when(gender == "f", _ENDINGS[script, "f"]).when(gender == "m", _ENDINGS[script, "m"]).otherwise(_ENDINGS[script, "u"])
        listed = F.lit(None).cast("string")
        for g, names in (("f", GIVEN_F), ("m", GIVEN_M)):
            own = [n for n in names if (n[0] > "Ͽ") == (script == "cyrillic")]
            pick = F.get(F.array(*[F.lower(F.lit(n)) for n in own]), _byte(digest, F.lit(9)) % len(own))
            listed = F.when((gender == g) & (attempt == 0), pick).otherwise(listed)
        return F.coalesce(listed, F.concat(F.array_join(parts, ""), end))

    # a name in a script without syllables here is drawn letter by letter and grows like the others
    grown = F.concat(drawn, F.substring(F.expr("repeat(_drawn, 8)"), F.lit(1), F.floor(attempt / 3).cast("int")))
    names = (F.when(value.rlike(r"\p{IsCyrillic}"), name("cyrillic")).when(value.rlike(r"[\u0370-\u03ff\u0530-\uffef]"), grown).otherwise(name("latin")))
    email = F.concat(_drawn(F.substring_index(value, "@", 1), digest), F.lit("@"), F.col("_host"), F.lit("."), F.col("_top"))
    return {"_digest": digest, "_drawn": drawn, "_domain": domain, "_top": top, "_hostpart": host, "first": head_kept,
            "card": F.concat(card, check), "email": email, "ip": ip, "name": names, "iban": iban}


def _draw(entities: DataFrame, key: str) -> DataFrame:
    """Adds ``surrogate`` to ``kind``, ``value``, ``attempt``."""
    kind, value, attempt = F.col("kind"), F.col("value"), F.col("attempt")
    x = _parts(key, kind, value, attempt)
    step = entities.withColumn("_drawn", F.when(kind.isin("hex", "ipv6"), _drawn(value, x["_digest"], True)).when(
        kind.isin("email", "ip") | ((kind.startswith("given") | (kind == "surname")) & ~value.rlike(r"[\u0370-\u03ff\u0530-\uffef]")), F.lit("")).otherwise(_drawn(value, x["_digest"])))
    step = step.withColumn("_domain", x["_domain"]).withColumn("_top", x["_top"]).withColumn("_hostpart", x["_hostpart"])
    step = step.withColumn("_host", _drawn(F.col("_hostpart"), _digest(key, F.lit("domain"), F.col("_domain"))))
    surrogate = (F.when(kind == "email", x["email"]).when(kind == "ip", x["ip"]).when(kind == "card", x["card"]).when(kind == "phone", x["first"])
                 .when(kind == "key", F.concat(F.substring(value, 1, 4), F.expr("substring(_drawn, 5)")))
                 .when(kind == "token", F.concat(F.regexp_extract(value, "^(ghp_|gho_|xoxb-|xoxp-|sk-)", 1),
                                                 F.expr("substring(_drawn, length(regexp_extract(value, '^(ghp_|gho_|xoxb-|xoxp-|sk-)', 1)) + 1)")))
                 .when(kind == "iban", x["iban"])
                 .when(kind.isin("hex", "ssn", "ipv6"), F.col("_drawn")).otherwise(x["name"]))
    return step.select("kind", "value", "attempt", surrogate.alias("surrogate"))


#: What a place of a surrogate may hold: digit, small and capital letter, hexadecimal digit; an octet stands for the numbers 1 to 254.
_CLASSES = {"0": "0123456789", "a": "abcdefghijklmnopqrstuvwxyz", "A": "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "h": "0123456789abcdef"}
_OCTETS = 254
_SHAPE = ["kind", "head", "template", "tail", "valid"]


def _shaped(rows: DataFrame) -> DataFrame:
    """Adds to ``kind`` and ``surrogate`` what all surrogates of one format share: fixed beginning and end, and the class of every place between."""
    kind, s = F.col("kind"), F.col("surrogate")
    at = (F.when(kind.isin("phone", "card"), 1).when(kind == "key", 4).when(kind == "iban", 2)
          .when(kind == "token", F.length(F.regexp_extract(s, "^(ghp_|gho_|xoxb-|xoxp-|sk-)", 1))).otherwise(0))
    free = (F.when(kind == "email", F.substring_index(s, "@", 1)).when(kind == "card", F.substring(s, F.lit(2), F.length(s) - 2))
            .otherwise(F.substring(s, at + 1, F.length(s))))
    letters = F.regexp_replace(F.regexp_replace(free, r"\p{Lu}", "A"), r"(?!A)\p{L}", "a")
    template = (F.when(kind.isin("hex", "ipv6"), F.regexp_replace(free, r"[0-9\p{L}]", "h")).when(kind == "ip", F.regexp_replace(free, r"\d+", "o"))
                .otherwise(F.regexp_replace(letters, r"\d", "0")))
    tail = F.when(kind == "email", F.concat(F.lit("@"), F.substring_index(s, "@", -1))).otherwise("")
    return rows.withColumns({"head": F.substring(s, F.lit(1), at), "template": template, "tail": tail})


def _base(c: Column) -> Column:
    return F.when(c == "0", 10).when(c.isin("a", "A"), 26).when(c == "h", 16).when(c == "o", _OCTETS).otherwise(1).cast("long")


def _numbered(number: Column) -> Column:
    """Surrogate ``number`` (from 0) of a format."""
    def put(done: Column, c: Column) -> Column:
        at = done["rest"] % _base(c)
        symbol = F.when(c == "o", (at + 1).cast("string"))
        for name, alphabet in _CLASSES.items():
            symbol = symbol.when(c == name, F.substring(F.lit(alphabet), at.cast("int") + 1, F.lit(1)))
        return F.struct(F.floor(done["rest"] / _base(c)).cast("long").alias("rest"), F.concat(done["out"], symbol.otherwise(c)).alias("out"))

    start = F.struct(number.cast("long").alias("rest"), F.lit("").alias("out"))
    body = F.concat("head", F.aggregate(F.split("template", ""), start, put)["out"], "tail")
    check = (10 - _luhn(F.concat(body, F.lit("0")))) % 10
    return F.when(F.col("kind") == "card", F.concat(body, F.when(F.col("valid"), check).otherwise((check + 1) % 10).cast("string"))).otherwise(body)


def _placed(open_: DataFrame, kept: DataFrame, originals: DataFrame, key: str) -> DataFrame:
    """``kind``, ``value``, ``surrogate`` for entities that blind draws did not place: the free surrogates of their format by rank.

    Of a format as many surrogates are listed as it has entities to place and surrogates or originals that may be taken, so there are enough free ones
    unless the format has no more; what is left then gets a format with one place more.
    """
    valid = F.when(F.col("kind") == "card", _luhn(F.col("value")) == 0).otherwise(False)
    rest = materialize(_shaped(open_).withColumn("valid", valid).select(*_SHAPE, "value"), "unplaced")
    done = None
    while True:
        used = kept if done is None else kept.unionByName(done)
        used = materialize(originals.where("g != 'name'").select(F.col("g").alias("kind"), "surrogate").union(used.select("kind", "surrogate")).distinct(), "used")
        taken = _shaped(used).groupBy("kind", "head", "template", "tail").agg(F.count("*").alias("taken"))
        space = F.aggregate(F.split("template", ""), F.lit(1.0), lambda p, c: p * _base(c))
        formats = rest.groupBy(*_SHAPE).agg(F.count("*").alias("k")).join(taken, ["kind", "head", "template", "tail"], "left")
        formats = formats.select(*_SHAPE, F.least(space, F.lit(1e15), F.col("k") + F.coalesce("taken", F.lit(0))).cast("long").alias("m"))
        piece = formats.withColumn("_from", F.explode(F.sequence(F.lit(0).cast("long"), F.col("m") - 1, F.lit(4096).cast("long")))).repartition("_from", *_SHAPE)
        listed = piece.withColumn("_i", F.explode(F.sequence("_from", F.least(F.col("_from") + 4095, F.col("m") - 1)))).withColumn("surrogate", _numbered(F.col("_i")))
        free = materialize(listed.join(used, ["kind", "surrogate"], "left_anti").select(*_SHAPE, "surrogate"), "free")
        ranks = []
        for table, name in ((rest, "value"), (free, "surrogate")):
            order = F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit(name), name).cast("binary"), 256)
            at = materialize(ranked(table, [*[F.col(c) for c in _SHAPE], order], "_at"), "at")
            first = at.groupBy(*_SHAPE).agg(F.min("_at").alias("_first"))
            ranks.append(at.join(first, _SHAPE).withColumn("_r", F.col("_at") - F.col("_first")).drop("_at", "_first"))
        both = materialize(ranks[0].join(ranks[1], [*_SHAPE, "_r"], "left"), "ranks")
        now = both.where("surrogate IS NOT NULL").select("kind", "value", "surrogate")
        done = materialize(now if done is None else done.unionByName(now), "placed")
        more = (F.when(F.col("kind").isin("hex", "ipv6"), "h").when(F.col("kind") == "ip", ".o").when(F.col("kind") == "key", "A")
                .when(F.col("kind").isin("email", "token"), "a").otherwise("0"))
        rest = materialize(both.where("surrogate IS NULL").withColumn("template", F.concat("template", more)).select(*_SHAPE, "value"), "unplaced")
        if rest.isEmpty():
            return done


def surrogates(entities: DataFrame, key: str, rounds: int = 6) -> DataFrame:
    """Mapping ``kind``, ``value``, ``surrogate`` without collisions for different (``kind``, ``value``).

    After ``rounds`` blind draws what is left is placed by rank; names go on, as theirs grow.
    """
    is_name = F.col("kind").startswith("given") | (F.col("kind") == "surname")
    group = F.when(is_name, "name").otherwise(F.col("kind"))
    kept = None
    originals = materialize(entities.select(group.alias("g"), F.col("value").alias("surrogate")).distinct(), "originals")
    open_ = materialize(entities.select("kind", "value", F.lit(0).alias("attempt")), "open")
    done = 0
    while True:
        drawn = _draw(open_, key).withColumn("g", group)
        fresh = drawn.join(originals.withColumn("_old", F.lit(True)), ["g", "surrogate"], "left")
        if kept is not None:
            fresh = fresh.join(kept.select(group.alias("g"), "surrogate", F.lit(True).alias("_used")), ["g", "surrogate"], "left")
        else:
            fresh = fresh.withColumn("_used", F.lit(None).cast("boolean"))
        fresh = materialize(fresh, "drawn")
        free = fresh.where("_old IS NULL AND _used IS NULL")
        first = materialize(free.groupBy("g", "surrogate").agg(F.min(F.struct("kind", "value")).alias("_first")).select(
            "_first.kind", "_first.value", "surrogate"), "first")
        kept = first if kept is None else materialize(kept.unionByName(first), "kept")
        left = materialize(fresh.join(first.select("kind", "value"), ["kind", "value"], "left_anti"), "left")
        done += 1
        if done == rounds:
            rest = left.where(~is_name).select("kind", "value", "surrogate")
            if not rest.isEmpty():
                kept = materialize(kept.unionByName(_placed(rest, kept, originals, key)), "kept")
        open_ = (left.where(is_name) if done >= rounds else left).select("kind", "value", (F.col("attempt") + 1).alias("attempt"))
        if open_.isEmpty():
            return kept


def _render(e: Column, kind: Column, surrogate: Column) -> Column:
    """The surrogate in the punctuation and case of the entity."""
    # numbers and accounts have few characters, so that a place may be counted out anew for each
    index = F.transform(F.split(e, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i")))
    # a surrogate of a wider format has more characters than the entity; they follow at the end
    plain = F.length(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))

    def put(x: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(e, F.lit(1), x["i"] + 1), r"[^\p{L}\p{N}]", ""))
        new = F.substring(surrogate, before, F.lit(1))
        return F.when(x["c"].rlike(r"^[\p{L}\p{N}]$"), F.when(x["c"].rlike(r"^\p{Lu}$"), F.upper(new)).otherwise(new)).otherwise(x["c"])

    # addresses have any length: place by place, both cut up once
    cased = F.array_join(F.zip_with(F.split(e, ""), F.split(surrogate, ""), lambda c, n: F.when(c.rlike(r"^\p{Lu}$"), F.upper(n)).otherwise(n)), "")
    name = F.when((F.length(e) > 1) & (e == F.upper(e)) & (e != F.lower(e)), F.upper(surrogate)).otherwise(F.initcap(surrogate))
    return (F.when(kind.startswith("given") | (kind == "surname"), name).when(kind.isin("ip", "key", "token", "hex"), surrogate)
            .when(kind.isin("email", "ipv6"), F.when(F.length(surrogate) != F.length(e), F.when(e == F.upper(e), F.upper(surrogate)).otherwise(surrogate)).otherwise(cased))
            .otherwise(F.concat(F.array_join(F.transform(index, put), ""), F.substring(surrogate, plain + 1, F.length(surrogate)))))


def replace(documents: DataFrame, key: str, text: str = "text", count: str | None = None) -> DataFrame:
    """``documents`` with every entity of ``text`` replaced; ``count`` names a further column for the number of entities of a row."""
    columns = documents.columns
    if count is not None:
        documents = documents.drop(count)
    own = [F.col(f"`{c}`") for c in documents.columns]
    body = F.col(f"`{text}`")
    k, cut, new = unused(documents.columns, "key", "cut", "new")
    maybe = F.coalesce(body.rlike(MAYBE), F.lit(False))
    digest = F.sha2(body.cast("binary"), 256)
    taken = documents.where(maybe).select(digest.alias("k"), _pieces(body).alias("p")).where(F.size("p") > 1)
    each = taken.select("k", _entities(F.col("p")).alias("found")).groupBy("k").agg(F.first("found").alias("found"))
    found = each.select("k", F.posexplode("found").alias("at", "x")).select("k", "at", "x.*")
    found = found.withColumn("kind", _kind(F.col("e"), F.col("before"), F.col("joined")))
    found = materialize(found.select("k", "at", "e", "kind", _canonical(F.col("kind"), F.col("e")).alias("value")), "occurrences")
    mapping = surrogates(found.select("kind", "value").distinct(), key)
    drawn = found.join(mapping, ["kind", "value"]).select("k", "at", _render(F.col("e"), F.col("kind"), F.col("surrogate")).alias("s"))
    by_text = materialize(drawn.groupBy("k").agg(F.sort_array(F.collect_list(F.struct("at", "s"))).alias("n")), "by_text").toDF(k, new)
    # the texts without entities stay where they are
    parts = F.when(maybe, _pieces(body))
    changed = documents.withColumn(cut, parts).where(F.size(cut) > 1).withColumn(k, digest).join(by_text, k)
    kept = F.filter(F.col(cut), lambda x, i: i % 2 == 0)
    woven = F.array_join(F.zip_with(kept, F.col(f"{new}.s"), lambda r, s: F.concat(r, F.coalesce(s, F.lit("")))), "")
    number = [] if count is None else [F.size(new).cast("long").alias(count)]
    none = [] if count is None else [F.lit(0).cast("long").alias(count)]
    changed = changed.select(*[woven.alias(c) if c == text else F.col(f"`{c}`") for c in documents.columns], *number)
    has = maybe & F.coalesce(body.rlike(EVERY), F.lit(False))
    out = documents.where(~has).select(*own, *none).unionByName(changed)
    return out if count is not None else out.select(*[F.col(f"`{c}`") for c in columns])
