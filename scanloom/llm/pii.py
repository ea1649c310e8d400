"""PII: detected entities get keyed surrogates of the same kind, script and format. Built-in functions only.

A pattern finds e-mail addresses, IPv4 addresses, account and card numbers, identity numbers, phone numbers, and names after one or more forms
of address: any number of capitalised words, initials with a dot, and particles between them. Names without a form of address aren't found. The same entity (compared by its letters and digits in lower case) gets the same surrogate in every document and spelling:
digits become digits, letters become letters of their script and case, separators stay; an address part stays below 256; an
e-mail address moves to a reserved domain; of a name, the last word gets a surname, each word before it a given name of the gender that the forms
of address tell, an initial another initial, all in the script of the original; particles stay. What differs between spellings of one entity is
taken from all of them or from its letters and digits: the country code is the one that its digits begin with, the gender the one that any form of
address tells (neutral where two contradict).

Surrogates come from a keyed SHA-512, so two entities can meet. The distinct entities of all documents are therefore held
against each other and against all surrogates: an entity whose surrogate is taken, or is some real entity, gets its next
surrogate, until none is left; it is an error if they don't get fewer. Each attempt has more values: longer local parts and more hosts, longer
surnames, double given names, more initials; numbers keep their format and are drawn again. Surnames are settled first, as entities of their own, and
full names keep them, so only the other parts of a full name move. Only those few exceptions, and names whose forms of address differ, are joined to
the documents, and only where there are any.

Defined results: a null text stays null, an empty one empty, both with 0 entities; repeated rows get the same text; other columns
are kept as they are. Texts are never shuffled unless exceptions exist, and then once, by row identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import stored

# Forms of address by gender, reserved domains, given names and parts of surnames by script and gender.
FEMALE = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "г-жа", "Κυρία"]
MALE = ["Mr", "Herr", "Señor", "Sr", "Monsieur", "г-н", "Κύριος"]
NEUTRAL = ["Dr", "Prof"]
# What may stand after a form of address, between the words of a name, and after a name without being part of it.
DEGREES = ["med", "dent", "vet", "phil", "jur", "iur", "rer", "nat", "pol", "oec", "techn", "theol", "habil", "mult", "Ing", r"h\. ?c"]
PARTICLES = ["von", "vom", "van", "der", "den", "dem", "de", "del", "della", "di", "da", "das", "do", "dos", "du", "des", "la", "le", "las", "los", "zu", "zum", "zur", "ten", "ter", "te", "af", "av", "bin", "ibn", "al", "el", "y", "e", "und"]
SUFFIXES = ["Jr", "Sr", "II", "III", "IV", "MD", "PhD"]
DOMAINS = ["example.com", "example.net", "example.org"]
GIVEN = {
    ("latin", "f"): ["Alice", "Clara", "Diana", "Elena", "Hanna", "Irene", "Laura", "Nina"],
    ("latin", "m"): ["Adam", "Boris", "David", "Henry", "Jonas", "Lukas", "Oscar", "Peter"],
    ("latin", "n"): ["Alex", "Andrea", "Charlie", "Jamie", "Kim", "Noel", "Robin", "Sasha"],
    ("cyrillic", "f"): ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"],
    ("cyrillic", "m"): ["Андрей", "Борис", "Виктор", "Иван", "Михаил", "Олег", "Павел", "Сергей"],
    ("cyrillic", "n"): ["Женя", "Саша", "Валя", "Слава", "Паша", "Шура", "Вася", "Тоня"],
    ("greek", "f"): ["Άννα", "Ελένη", "Ειρήνη", "Μαρία", "Σοφία", "Δήμητρα", "Ζωή", "Χλόη"],
    ("greek", "m"): ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Στέφανος", "Χρήστος", "Ανδρέας"],
    ("greek", "n"): ["Αλέξης", "Φώτης", "Χάρις", "Μάκης", "Άρης", "Λάκης", "Σάκης", "Τάκης"],
}
SYLLABLES = {
    "latin": ["ba", "der", "fin", "gol", "har", "kes", "lin", "mar", "nor", "pel", "ros", "sim", "tan", "ven", "wes", "zim"],
    "cyrillic": ["ба", "вер", "гор", "дан", "зим", "кол", "лин", "мар", "нов", "пет", "рос", "сим", "тан", "фед", "хар", "чер"],
    "greek": ["βα", "γορ", "δημ", "ζαν", "θεο", "καλ", "λιν", "μαρ", "νικ", "παπ", "ροδ", "σιμ", "ταν", "φιλ", "χαρ", "ψαλ"],
}
#: Country codes; no code begins with another.
COUNTRY = r"(?:1|7|20|27|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3})"
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}

_AN = r"\p{L}\p{N}"
_TITLE = "|".join(FEMALE + MALE + NEUTRAL)
_TITLES = rf"(?:(?:{_TITLE})\.? (?:(?:{'|'.join(DEGREES)})\. )*+)++"
_TAIL = r"[\p{L}\p{M}'’-]"
#: The rest of a name's word: an apostrophe belongs to it unless it ends the word, alone or with an s. So a possessive is no part of the name.
_REST = rf"(?:[\p{{L}}\p{{M}}-]|['’](?!s?+(?!{_TAIL})))"
_INITIALS = r"\p{Lu}\.(?:-?\p{Lu}\.)*+"
_WORD = rf"(?!(?:{_TITLE}|{'|'.join(SUFFIXES)})(?!{_TAIL}))(?:(?:\p{{Lu}}\.-?)*+(?:[dl]['’]|[ae]l-)?+\p{{Lu}}{_REST}++|{_INITIALS})"
_PART = rf"(?:(?:{'|'.join(PARTICLES)}) )*+{_WORD}"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
PATTERNS = {
    "email": rf"(?<![{_AN}._%+-])[{_AN}\p{{M}}._%+-]++@[{_AN}-]++(?:\.[{_AN}-]++)++",
    "ipv4": rf"(?<![\d.])(?:{_OCTET}\.){{3}}{_OCTET}(?![\d]|\.\d)",
    "iban": rf"(?<![{_AN}])[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_AN}])",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "card": r"(?<![\d+])\d{4}(?:[ -]?\d{4}){2}[ -]?\d{1,7}(?!\d)",
    "phone": rf"(?<![{_AN}])(?:\+\d{{1,3}}[ .-]?(?:\(\d{{1,4}}\)[ .-]?)?\d{{2,4}}(?:[ .-]?\d{{2,4}}){{1,4}}|\(\d{{2,4}}\)[ .-]?\d{{3,4}}[ .-]\d{{3,4}}|\d{{3}}[.-]\d{{3}}[.-]\d{{4}})(?!\d)",
    "name": rf"(?<![{_AN}]){_TITLES}{_PART}(?: {_PART})*+",
}
ANY = "|".join(PATTERNS.values())
#: Every entity holds one of these, so a text without them needs no search.
GATE = rf"@|\d[\d .()-]{{5}}|(?:{_TITLE})\.? \p{{L}}"


def kind_of(e: Column) -> Column:
    """Kind of a found entity; as in the pattern, the first kind that fits."""
    out = F.when(e.contains("@"), "email")
    for kind in ("ipv4", "iban", "ssn", "card"):
        out = out.when(e.rlike(f"^(?:{PATTERNS[kind]})$"), kind)
    return out.when(e.rlike(r"^[+(\d]"), "phone").otherwise("name")


def _let(value: Column, then) -> Column:
    """``then(value)``, with the value computed once and its expression written once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _plain(e: Column) -> Column:
    return F.lower(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))


def person(e: Column) -> Column:
    """The name without its forms of address."""
    return F.regexp_replace(e, f"^{_TITLES}", "")


def canonical(kind: Column, e: Column) -> Column:
    """What tells entities of a kind apart."""
    plus = F.when(e.startswith("+"), "+").otherwise("")
    return F.when(kind == "name", F.lower(person(e))).when(kind.isin("email", "ipv4"), F.lower(e)).otherwise(F.concat(plus, _plain(e)))


def surname(kind: Column, e: Column) -> Column:
    """The canonical form of a name's surname alone; null for other kinds and where there are only initials."""
    return F.when(kind == "name", F.lower(_surname_of(F.split(person(e), " "))))


def _byte(h: Column, i) -> Column:
    """Byte i of a hexadecimal SHA-512."""
    at = i if isinstance(i, Column) else F.lit(i)
    return F.conv(F.substring(h, F.pmod(at, F.lit(64)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _pick(values: list[str], n: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), F.pmod(n, F.lit(len(values))) + 1)


def _script(e: Column) -> Column:
    return F.when(e.rlike(r"\p{IsCyrillic}"), "cyrillic").when(e.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _by_script(e: Column, make) -> Column:
    s = _script(e)
    return F.when(s == "cyrillic", make("cyrillic")).when(s == "greek", make("greek")).otherwise(make("latin"))


def _letters(plain: Column, h: Column, zero_first: bool = True) -> Column:
    """A string of the same length, letter for letter and digit for digit."""

    def one(c: Column, i: Column) -> Column:
        b = _byte(h, i)
        digit = F.when(i == 0, F.pmod(b, F.lit(9)) + 1).otherwise(F.pmod(b, F.lit(10)))
        return F.when(c.rlike(r"\p{N}"), digit.cast("string")).otherwise(_by_script(c, lambda s: F.substring(F.lit(LETTERS[s]), F.pmod(b, F.lit(len(LETTERS[s]))) + 1, F.lit(1))))

    return F.array_join(F.transform(F.split(plain, ""), one), "")


def _overlay(shape: Column, value: Column) -> Column:
    """The letters and digits of ``value`` in the places, and with the case, of those of ``shape``."""

    def one(c: Column, i: Column) -> Column:
        at = F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), r"[^\p{L}\p{N}]", "")) + 1
        new = F.substring(value, at, F.lit(1))
        return F.when(c.rlike(r"[\p{L}\p{N}]"), F.when(c.rlike(r"\p{Lu}"), F.upper(new)).otherwise(new)).otherwise(c)

    return F.array_join(F.transform(F.split(shape, ""), one), "")


def _hash(key: str, kind: Column, canon: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 512)


def _gender(e: Column) -> Column:
    """What the forms of address of a found name tell."""
    title = F.regexp_extract(e, f"^{_TITLES}", 0)
    female, male = (title.rlike(rf"(?<!\S)(?:{'|'.join(t)})[. ]") for t in (FEMALE, MALE))
    return F.when(female, "f").when(male, "m").otherwise("n")


def _is_initial(w: Column) -> Column:
    return w.rlike(f"^{_INITIALS}$")


def _is_word(w: Column) -> Column:
    return w.rlike(r"\p{Lu}") & ~_is_initial(w)


def _surname_of(parts: Column) -> Column:
    """The last word of a name's parts; null where there are only initials."""
    return F.try_element_at(F.filter(parts, _is_word), F.lit(-1))


def _name(key: str, e: Column, attempt: Column, base: Column, gender: Column) -> Column:
    """Each part by itself, so that a surname alone is the surname of the full name. ``base``: the surname's attempt."""
    return _let(F.split(person(e), " "), lambda parts: _let(F.array_position(F.reverse(parts), _surname_of(parts)), lambda last: _parts(key, e, parts, last, attempt, base, gender)))


def _parts(key: str, e: Column, parts: Column, last: Column, attempt: Column, base: Column, gender: Column) -> Column:
    """The forms of address of ``e`` and a surrogate for each of ``parts``; ``last`` is the surname's place from the end."""

    def family(w: Column) -> Column:  # a syllable more with each attempt: there is always a free one
        make = lambda h: _by_script(w, lambda s: F.array_join(F.transform(F.sequence(F.lit(1), base + 4), lambda i: _pick(SYLLABLES[s], _byte(h, i))), ""))
        return F.initcap(_let(_hash(key, F.lit("surname"), F.lower(w), base), make))

    def given(w: Column) -> Column:  # a double name from the second attempt on, two syllables more with each
        def make(h: Column) -> Column:
            def of(s: str) -> Column:
                b = _byte(h, 0)
                first = F.when(gender == "f", _pick(GIVEN[s, "f"], b)).when(gender == "m", _pick(GIVEN[s, "m"], b)).otherwise(_pick(GIVEN[s, "n"], b))
                second = F.array_join(F.transform(F.sequence(F.lit(1), attempt * 2), lambda i: _pick(SYLLABLES[s], _byte(h, i))), "")
                return F.when(attempt > 0, F.concat(first, F.lit("-"), F.initcap(second))).otherwise(first)

            return _by_script(w, of)

        return _let(_hash(key, F.lit("given"), F.lower(w), attempt), make)

    def initial(w: Column) -> Column:  # an initial more with each attempt
        def make(h: Column) -> Column:
            letter = lambda i: F.concat(_by_script(w, lambda s: F.upper(_pick(list(LETTERS[s]), _byte(h, i + 8)))), F.lit("."))
            more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), letter), "")).otherwise("")
            return F.concat(_overlay(w, _letters(_plain(w), h)), more)

        return _let(_hash(key, F.lit("initial"), F.lower(w), attempt), make)

    def one(w: Column, i: Column) -> Column:
        word = F.when(F.size(parts) - i == last, family(w)).otherwise(given(w))
        return F.when(_is_initial(w), initial(w)).when(_is_word(w), word).otherwise(w)

    return F.concat(F.regexp_extract(e, f"^{_TITLES}", 0), F.array_join(F.transform(parts, one), " "))


def surrogate(key: str, kind: Column, e: Column, attempt: Column, base: Column, gender: Column) -> Column:
    """The surrogate of a found entity, in its format: the same value for all spellings of one canonical form.

    ``base`` and ``gender``, for names: the attempt of the surname, and the gender that all spellings tell together.
    """
    known = F.struct(kind.alias("k"), e.alias("e"), canonical(kind, e).alias("canon"), attempt.alias("attempt"), base.alias("base"), gender.alias("gender"))

    def hashed(x: Column) -> Column:
        return _let(F.when(x["k"] != "name", _hash(key, x["k"], x["canon"], x["attempt"])), lambda h: _surrogate(key, x["k"], x["e"], x["canon"], h, x["attempt"], x["base"], x["gender"]))

    return _let(known, hashed)


def _surrogate(key: str, kind: Column, e: Column, canon: Column, h: Column, attempt: Column, base: Column, gender: Column) -> Column:
    local = F.substring_index(e, "@", 1)
    letter = lambda i: _by_script(local, lambda s: _pick(list(LETTERS[s]), _byte(h, i + 40)))
    more = F.when(attempt > 0, F.array_join(F.transform(F.sequence(F.lit(1), attempt), letter), "")).otherwise("")
    host = F.when(attempt > 0, F.concat(F.lit("mail"), _byte(h, 62).cast("string"), F.lit("."))).otherwise("")
    email = F.concat(_overlay(local, _letters(_plain(local), h)), more, F.lit("@"), host, _pick(DOMAINS, _byte(h, 63)))
    ipv4 = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda i: _byte(h, i).cast("string")), ".")
    plain = _plain(e)
    code = F.when(kind == "iban", F.substring(plain, 1, 2)).otherwise(F.regexp_extract(canon, rf"^\+({COUNTRY})", 1))  # a country stays
    number = _overlay(e, F.concat(code, _letters(F.substring(plain, F.length(code) + 1, F.length(plain)), h)))
    return F.when(kind == "email", email).when(kind == "ipv4", ipv4).when(kind == "name", _name(key, e, attempt, base, gender)).otherwise(number)


def entities(text: Column) -> Column:
    """All found entities of a text, in order."""
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))
    return F.when(text.rlike(GATE), found).otherwise(F.array().cast("array<string>"))


def _settled(known: DataFrame, key: str, rounds: int) -> DataFrame:
    """``known`` (kind, canon, e, gender, mixed, base) with the attempt at which each has a surrogate of its own.

    ``base`` is null where the attempt is also the surname's. ``rounds``: that many in a row may leave as many without one.
    """

    def drawn(rows: DataFrame) -> DataFrame:
        kind, attempt = F.col("kind"), F.col("attempt")
        # Dealt by number: the rows are few bytes but much work, and adaptive execution would fold them into one task.
        rows = rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
        return stored(rows.withColumn("new", canonical(kind, surrogate(key, kind, F.col("e"), attempt, F.coalesce("base", attempt), F.col("gender")))))

    now = drawn(known.withColumn("attempt", F.lit(0)))
    real = now.select(F.col("kind").alias("_k"), F.col("canon").alias("_c"))
    least, idle = None, 0
    while True:
        rank = F.row_number().over(Window.partitionBy("kind", "new").orderBy("attempt", "canon"))
        marked = now.withColumn("rank", rank).join(real, (F.col("kind") == F.col("_k")) & (F.col("new") == F.col("_c")), "left")
        marked = stored(marked.withColumn("bad", (F.col("rank") > 1) | F.col("_c").isNotNull()).drop("rank", "_k", "_c"))
        bad = marked.where("bad").count()
        if not bad:
            return now.drop("new")
        least, idle = (bad, 0) if least is None or bad < least else (least, idle + 1)
        if idle >= rounds:
            raise RuntimeError(f"surrogates did not settle: {bad} entities have none of their own")
        now = drawn(marked.withColumn("attempt", F.col("attempt") + F.col("bad").cast("int")).drop("bad", "new"))


def exceptions(found: DataFrame, key: str, rounds: int = 20) -> DataFrame:
    """(kind, canon, attempt, gender) of the entities that can't have their first surrogate, or whose spellings tell different
    genders. ``found``: (kind, e, canon), distinct."""
    own = F.when(F.col("kind") == "name", _gender(F.col("e")))
    told = found.withColumn("own", own).groupBy("kind", "canon").agg(F.min("e").alias("e"), F.min("own").alias("lo"), F.max("own").alias("hi"), F.max(F.col("own") == "f").alias("f"), F.max(F.col("own") == "m").alias("m"))
    gender = F.when(F.col("kind") == "name", F.when(F.col("f") & ~F.col("m"), "f").when(F.col("m") & ~F.col("f"), "m").otherwise("n"))
    known = told.withColumn("surname", surname(F.col("kind"), F.col("e")))
    known = stored(known.select("kind", "canon", "e", gender.alias("gender"), F.coalesce(F.col("lo") != F.col("hi"), F.lit(False)).alias("mixed"), "surname"))
    full = (F.col("kind") == "name") & (F.col("surname").isNull() | (F.col("surname") != F.col("canon")))
    # Surnames of full names count as found by themselves.
    alone = known.where(full & F.col("surname").isNotNull()).select("kind", F.col("surname").alias("canon"), _surname_of(F.split(person(F.col("e")), " ")).alias("e"))
    first = known.where(~full).select("kind", "canon", "e").union(alone).groupBy("kind", "canon").agg(F.min("e").alias("e"))
    first = _settled(first.select("*", F.lit("n").alias("gender"), F.lit(False).alias("mixed"), F.lit(None).cast("int").alias("base")), key, rounds)
    at = first.where((F.col("kind") == "name") & (F.col("attempt") > 0)).select(F.col("canon").alias("surname"), F.col("attempt").alias("base"))
    names = known.where(full).join(at, "surname", "left").select("kind", "canon", "e", "gender", "mixed", F.coalesce("base", F.lit(0)).alias("base"))
    return first.unionByName(_settled(names, key, rounds)).where("attempt > 0 or mixed").select("kind", "canon", "attempt", "gender")


def replace_pii(docs: DataFrame, key: str = "surrogates", id_col: str = "doc_id", text_col: str = "text", count_col: str | None = "n_entities") -> DataFrame:
    """``docs`` with every entity of ``text_col`` replaced, and the number of entities in ``count_col``, in place of a column of that name if there is one."""
    e = F.explode(F.array_distinct(entities(F.col(text_col)))).alias("e")
    found = docs.select(e).distinct().withColumn("kind", kind_of(F.col("e")))
    found = found.withColumn("canon", canonical(F.col("kind"), F.col("e")))
    moved = exceptions(found, key)
    names = docs.columns
    if moved.isEmpty():
        work = docs.withColumn("__pii_moved", F.lit(None).cast("map<string,struct<attempt:int,gender:string>>"))
    else:
        seen = docs.select(F.col(id_col).alias("_id"), e).withColumn("kind", kind_of(F.col("e")))
        forms = F.array_distinct(F.array_compact(F.array(canonical(F.col("kind"), F.col("e")), surname(F.col("kind"), F.col("e")))))
        seen = seen.select("_id", "kind", F.explode(forms).alias("canon")).join(moved, ["kind", "canon"])
        per = seen.select("_id", F.concat_ws("\x1f", "kind", "canon").alias("k"), F.struct("attempt", "gender").alias("v")).distinct()
        per = per.groupBy("_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("__pii_moved"))
        per = per.withColumnRenamed("_id", "__pii_id")
        work = docs.join(per, docs[id_col].eqNullSafe(F.col("__pii_id")), "left").drop("__pii_id")

    def new(x: Column) -> Column:
        def of(y: Column) -> Column:  # y: kind and text, so that the kind is found once
            k, t = y["k"], y["e"]
            moved_to = lambda canon: F.element_at(F.col("__pii_moved"), F.concat_ws("\x1f", k, canon))
            own, told, none = moved_to(canonical(k, t)), _gender(t), F.col("__pii_moved").isNull()
            attempt = F.when(none, 0).otherwise(F.coalesce(own["attempt"], F.lit(0)))
            base = F.when(none, 0).otherwise(F.coalesce(moved_to(surname(k, t))["attempt"], F.lit(0)))
            return surrogate(key, k, t, attempt, base, F.when(none, told).otherwise(F.coalesce(own["gender"], told)))

        return F.element_at(F.transform(F.array(F.struct(kind_of(x).alias("k"), x.alias("e"))), of), 1)

    def fill(p: Column) -> Column:  # gaps and entities take turns
        return F.array_join(F.zip_with(p["gaps"], F.concat(F.transform(p["found"], new), F.array(F.lit(""))), lambda g, s: F.concat(g, s)), "")

    text = F.col(text_col)
    parts = F.array(F.struct(F.split(text, ANY, -1).alias("gaps"), F.regexp_extract_all(text, F.lit(ANY), F.lit(0)).alias("found")))
    done = F.element_at(F.transform(parts, lambda p: F.struct(fill(p).alias("text"), F.size(p["found"]).alias("n"))), 1)
    work = work.withColumn("__pii_done", F.when(text.rlike(GATE), done).otherwise(F.struct(text.alias("text"), F.lit(0).alias("n"))))
    count = [F.col("__pii_done.n").cast("long").alias(count_col)] if count_col else []
    return work.select(*[F.col("__pii_done.text").alias(c) if c == text_col else F.col(f"`{c}`") for c in names if c != count_col], *count)


def op2_pii(docs: DataFrame) -> DataFrame:
    return replace_pii(docs).select("doc_id", "text", "n_entities")
