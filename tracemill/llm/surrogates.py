"""Replacement of personal data by keyed surrogates, with DataFrame functions only.

A text is split at the detected mentions into literal parts and atoms: an address, a number, a secret, a given or
a family name. Names are detected behind a title; every other place in the same text that has one of them as a whole
word is a mention too, and a given name's gender is that of its first mention behind a title that tells. Each
different atom gets one surrogate for the whole table, so mentions stay coreferent; it is derived from a key and keeps
the atom's type, shape, script and gender. Surrogates that two atoms share, or that occur in the table themselves, are
drawn again until all are distinct. Only atoms and texts with a mention move between tasks; the others stay where they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracemill.llm import common

TITLES_M = ["Mr", "Mister", "Herr", "Herrn", "Monsieur", "Señor", "Signor", "Господин", "Κύριος"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mademoiselle", "Señora", "Señorita", "Signora", "Госпожа", "Κυρία"]
TITLES_N = ["Dr", "Prof", "Professor", "Doktor", "Docteur", "Doctor"]
#: Given names by script and gender, and syllables of family names by script. Latin also serves other scripts.
GIVEN = {
    "latin:m": "Adrian Bruno Carl Dario Emil Felix Gregor Hugo Ivo Jonas Konrad Linus Marco Nils Oscar Paul",
    "latin:f": "Agnes Berta Clara Dora Elsa Flora Greta Helena Irma Julia Klara Lena Marta Nora Olga Paula",
    "latin:n": "Alex Robin Kim Sascha Noa Charlie Jamie Andrea",
    "cyrillic:m": "Антон Борис Виктор Глеб Денис Егор Иван Максим",
    "cyrillic:f": "Анна Вера Галина Дарья Елена Инна Мария Нина",
    "cyrillic:n": "Саша Женя Валя Слава",
    "greek:m": "Νίκος Γιώργος Πέτρος Στέλιος",
    "greek:f": "Μαρία Ελένη Σοφία Δέσποινα",
    "greek:n": "Άλεξ Αρίστη Φώτη Χρύση",
}
SYLLABLES = {
    "latin": "ba be bo da del do fa fel ga gor ha hol ka kel la lin ma mar na nor pa per ra ros sa sel ta tor va ven wa zel",
    "cyrillic": "ба ве го да ел за ка ла ми но па ро са та ур ха",
    "greek": "βα γε δο ζα θε κα λι μα νο πα ρο σα τε φι χα ψη",
}
NAME = r"[\p{Lu}][\p{L}'’-]+"
#: Words of a name that are no name by themselves.
PARTICLES = "van von der den de del della di da dos du la le zu zum ten ter bin ibn al el".split()
PARTICLE = "(?:(?:" + "|".join(PARTICLES) + ") )"
TITLE = r"\b(?:" + "|".join(TITLES_M + TITLES_F + TITLES_N) + r")\b\.?"
#: First letters of titles: looked at before the words themselves, which is several times faster.
TITLE_START = "(?=[" + "".join(sorted({t[0] for t in TITLES_M + TITLES_F + TITLES_N})) + "])"
SECRET_LABEL = r"(?i:\b(?:password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key)\b[\"']?[ \t]?[=:][ \t]?[\"']?)"
BIRTH_LABEL = r"(?i:\b(?:born(?: on)?|date of birth|birth ?date|dob|geboren am|geb\.|née? le)[ \t]?:?[ \t]?)"
PASSPORT_LABEL = r"(?i:\b(?:passport|reisepass|passeport)(?: (?:no\.?|number|nr\.?))?[ \t]?:?[ \t]?)"
#: Kinds whose mention begins with a label that stays.
LABELS = {"secret": SECRET_LABEL, "birth": BIRTH_LABEL, "passport": PASSPORT_LABEL}
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
#: Kinds in the order they are tried, with their patterns (Java's).
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
    "secret": SECRET_LABEL + r"[A-Za-z0-9_+/.~-]{8,}",
    "awskey": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "iban": r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "card": r"(?<![0-9.-])(?:[3-6][0-9]{3}([ -]?)[0-9]{4}\1[0-9]{4}\1[0-9]{1,4}|3[47][0-9]{2}[ -]?[0-9]{6}[ -]?[0-9]{5})(?![0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "ipv4": rf"(?<![0-9.]){OCTET}(?:\.{OCTET}){{3}}(?![0-9]|\.[0-9])",
    "ipv6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]*[0-9])(?=(?:[0-9A-Fa-f]*:){3})(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\p{L}\p{N}:])",
    "birth": BIRTH_LABEL + r"(?:[0-9]{1,2}(?<mark>[./-])[0-9]{1,2}\k<mark>[0-9]{4}|[0-9]{4}-[0-9]{2}-[0-9]{2})(?![0-9])",
    "passport": PASSPORT_LABEL + r"(?=[A-Z]{0,3}[0-9])[A-Z0-9]{6,9}\b",
    "phone": r"(?<![0-9])(?:0[0-9]{2,4} ?/ ?[0-9]{5,9}|\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)|[0-9]{1,4})(?:[ .-]?[0-9]{2,4}){2,4}|\([0-9]{2,4}\)[ .-]?[0-9]{3,4}[ .-]?[0-9]{3,4}|[0-9]{3}[ .-][0-9]{3}[ .-][0-9]{4})(?![0-9])",
    "person": TITLE_START + TITLE + rf" {PARTICLE}{{0,3}}{NAME}(?: {PARTICLE}{{0,3}}{NAME}){{0,2}}",
}
MENTION = "|".join(f"(?:{p})" for p in PATTERNS.values())
ROUNDS = 60
SEGMENTS = "array<struct<kind:string,pre:string,value:string>>"


def _is(kind: str, c: Column) -> Column:
    return c.rlike(f"^(?:{PATTERNS[kind]})$")


def _script(c: Column) -> Column:
    return F.when(c.rlike(r"\p{IsCyrillic}"), "cyrillic").when(c.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _person(m: Column) -> Column:
    words = F.split(m, " ")
    title = F.regexp_replace(words[0], r"\.$", "")
    gender = F.when(title.isin(TITLES_M), "m").when(title.isin(TITLES_F), "f").otherwise("n")

    def word(w: Column, i: Column) -> Column:
        kind = F.when((i == 0) | w.isin(PARTICLES), F.lit(None)).when(i == F.size(words) - 1, F.concat(F.lit("family:"), _script(w))).otherwise(F.concat(F.lit("given:"), _script(w), F.lit(":"), gender))
        return F.struct(kind.cast("string").alias("kind"), F.when(i == 0, "").otherwise(" ").alias("pre"), w.alias("value"))

    return F.transform(words, word)


def _literal(c: Column) -> Column:
    return F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.lit("").alias("pre"), c.alias("value"))).cast(SEGMENTS)


def _atoms(m: Column) -> Column:
    """A mention as segments."""

    def one(kind: str, pre: Column, value: Column) -> Column:
        return F.array(F.struct(F.lit(kind).alias("kind"), pre.alias("pre"), value.alias("value")))

    out = F.when(_is("email", m), one("email", F.lit(""), m))
    for kind in [k for k in PATTERNS if k not in ("email", "person")]:
        is_kind = _is(kind, m)
        if kind == "card":  # other long numbers fail the check sum and stay
            out = out.when(is_kind & (_luhn(F.regexp_replace(m, "[^0-9]", "")) != 0), _literal(m))
        label = f"^{LABELS[kind]}" if kind in LABELS else "^"
        out = out.when(is_kind, one(kind, F.regexp_extract(m, label, 0), F.regexp_replace(m, label, "")))
    return out.otherwise(_person(m)).cast(SEGMENTS)


def segments(text: Column) -> Column:
    """Literal parts (kind null) and atoms of a text, in order; together they spell it."""
    found = F.regexp_extract_all(text, F.lit(MENTION), F.lit(0))
    return F.flatten(F.zip_with(F.split(text, MENTION, -1), found, lambda a, m: F.when(m.isNull(), _literal(a)).otherwise(F.concat(_literal(a), _atoms(m)))))


def _is_name(s: Column) -> Column:
    return F.coalesce(s["kind"].rlike("^(?:given|family):"), F.lit(False))


def names_of(segs: Column) -> Column:
    """kind and value of each different name in a text's segments: a name's kind is its first with a gender, or else its first."""
    names = F.filter(segs, _is_name)
    clear = F.filter(names, lambda s: ~s["kind"].endswith(":n"))
    values = F.array_distinct(F.transform(names, lambda s: s["value"]))
    of = lambda some, v: F.filter(some, lambda s: s["value"] == v)
    kind = lambda v: F.coalesce(F.get(of(F.filter(clear, lambda s: s["kind"].startswith("given")), v), F.lit(0))["kind"], F.get(of(clear, v), F.lit(0))["kind"], F.get(of(names, v), F.lit(0))["kind"])
    return F.transform(values, lambda v: F.struct(kind(v).alias("kind"), v.alias("value")))


def coreferent(segs: Column, names: Column) -> Column:
    """Segments with the names of the text found wherever they stand as whole words, each under its one kind."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}'’-])(?:"), F.array_join(F.transform(names, lambda n: n["value"]), "|"), F.lit(r")(?![\p{L}\p{N}-])"))

    def name(v: Column) -> Column:
        kind = F.get(F.filter(names, lambda n: n["value"] == v), F.lit(0))["kind"]
        return F.array(F.struct(kind.alias("kind"), F.lit("").alias("pre"), v.alias("value"))).cast(SEGMENTS)

    def again(s: Column) -> Column:
        parts, found = F.split(s["value"], pattern, -1), F.regexp_extract_all(s["value"], pattern, F.lit(0))
        spelled = F.flatten(F.zip_with(parts, found, lambda a, v: F.when(v.isNull(), _literal(a)).otherwise(F.concat(_literal(a), name(v)))))
        kind = F.get(F.filter(names, lambda n: n["value"] == s["value"]), F.lit(0))["kind"]
        same = F.array(F.struct(F.when(_is_name(s), kind).otherwise(s["kind"]).alias("kind"), s["pre"].alias("pre"), s["value"].alias("value"))).cast(SEGMENTS)
        return F.when(s["kind"].isNull() & (s["pre"] == ""), spelled).otherwise(same)

    return F.when(F.size(names) == 0, segs).otherwise(F.flatten(F.transform(segs, again)))


def norm(kind: Column, value: Column) -> Column:
    """What mentions of one entity share."""
    return F.when(kind.isin("phone", "card", "ssn"), F.regexp_replace(value, "[^0-9]", "")).when(kind == "iban", F.replace(value, F.lit(" "), F.lit(""))).when(kind.isin("secret", "awskey", "birth", "passport"), value).otherwise(F.lower(value))


def _draw(seed: Column, i: Column, n) -> Column:
    """A number below n for the i-th place."""
    return (F.conv(F.substring(F.sha2(F.concat(seed, F.lit("|"), i.cast("string")), 256), 1, 12), 16, 10).cast("long") % n).cast("int")


def _shape(value: Column, seed: Column, keep: Column) -> Column:
    """Digits for digits, letters for letters of the same case; the first `keep` characters stay."""

    def put(c: Column, i: Column) -> Column:
        letter = lambda first: F.char(_draw(seed, i, 26) + ord(first))
        return F.when(i < keep, c).when(c.rlike("[0-9]"), _draw(seed, i, 10).cast("string")).when(c.rlike("[a-z]"), letter("a")).when(c.rlike("[A-Z]"), letter("A")).when(c.rlike(r"\p{IsCyrillic}"), _pick("а б в г д е ж з и к л м н о п р с т у ф х ц ч ш э ю я", _draw(seed, i, 27))).when(c.rlike(r"\p{L}"), letter("a")).otherwise(c)

    return F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), put), "")


def _luhn(digits: Column) -> Column:
    """The check sum modulo 10."""
    n = F.length(digits)

    def part(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, d).otherwise(F.when(d > 4, 2 * d - 9).otherwise(2 * d))

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), part), F.lit(0), lambda a, b: a + b) % 10


def _mod97(c: Column) -> Column:
    """Of upper-case letters (from 10) and digits as one number."""
    letter = lambda x: F.ascii(x) - 55
    return F.aggregate(F.filter(F.split(c, ""), lambda x: x != ""), F.lit(0), lambda a, x: F.when(x.rlike("[0-9]"), (a * 10 + x.try_cast("int")) % 97).otherwise((a * 100 + letter(x)) % 97).cast("int"))


def _pick(words: str, at: Column) -> Column:
    return F.array(*[F.lit(w) for w in words.split()])[at]


def surrogate(kind: Column, value: Column, key: str, attempt: int) -> Column:
    """The surrogate of a normalized atom at an attempt; later attempts at kinds of free length draw longer ones."""
    seed = F.concat(F.lit(key), F.lit("|"), kind, F.lit("|"), value, F.lit(f"|{attempt}"))
    extra = max(0, attempt - 2)
    tail = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(extra)), lambda i: F.char(_draw(seed, i + 1000, 26) + 97)), "") if extra else F.lit("")
    local = F.substring_index(value, "@", 1)
    email = F.concat(_shape(local, seed, F.lit(0)), tail, F.lit("@mail"), (_draw(seed, F.lit(500), 9) + 1).cast("string"), F.lit(".example.org"))
    phone = _shape(value, seed, F.greatest(F.length(value) - 10, F.lit(0)))
    card = _shape(value, seed, F.lit(1))
    body = F.substring(card, F.lit(1), F.length(card) - 1)
    card = F.concat(body, ((10 - _luhn(F.concat(body, F.lit("0")))) % 10).cast("string"))  # with a right check digit
    ip = F.concat_ws(".", (_draw(seed, F.lit(0), 15) + 240).cast("string"), *[(_draw(seed, F.lit(i), 254) + 1).cast("string") for i in (1, 2, 3)])
    account = F.upper(_shape(F.substring(value, F.lit(5), F.length(value)), seed, F.lit(0)))
    country = F.upper(F.substring(value, 1, 2))
    iban = F.concat(country, F.lpad((98 - _mod97(F.concat(account, country, F.lit("00")))).cast("string"), 2, "0"), account)  # with right check digits
    ip6 = F.concat(F.lit("2001:db8:"), *[F.concat(F.lower(F.hex(_draw(seed, F.lit(i), 65535) + 1)), F.lit(":" if i < 5 else "")) for i in range(6)])
    day, month = (F.lpad((_draw(seed, F.lit(i), n) + 1).cast("string"), 2, "0") for i, n in ((0, 28), (1, 12)))
    year = (_draw(seed, F.lit(2), 70) + 1935).cast("string")
    birth = F.when(value.rlike("^[0-9]{4}-"), F.concat_ws("-", year, month, day)).otherwise(F.concat(day, F.regexp_extract(value, "[./-]", 0), month, F.regexp_extract(value, "[./-]", 0), year))
    simple = {"email": email, "phone": phone, "card": card, "ssn": _shape(value, seed, F.lit(0)), "ipv4": ip, "ipv6": ip6, "birth": birth, "passport": F.upper(_shape(value, seed, F.lit(0))), "iban": iban, "awskey": _shape(value, seed, F.lit(4)), "secret": F.concat(_shape(value, seed, F.lit(0)), tail)}
    out = F.lit(None).cast("string")
    for name, new in simple.items():
        out = F.when(kind == name, new).otherwise(out)
    if attempt >= ROUNDS:  # the kind's form has nothing left
        return F.concat(F.regexp_extract(kind, "^[a-z0-9]+", 0), F.lit("-"), F.substring(F.sha2(seed, 256), 1, 32))
    for script, words in SYLLABLES.items():
        n = len(words.split())
        syllables = lambda low, high, words=words, n=n: F.concat(*[_pick(words, _draw(seed, F.lit(i), n)) for i in range(low, high)])
        second = F.when(F.contains(value, F.lit("-")), F.concat(F.lit("-"), syllables(100, 102))).otherwise("")
        out = F.when(kind == f"family:{script}", F.concat(syllables(0, 3 + extra), second)).otherwise(out)
    for group, words in GIVEN.items():
        n = len(words.split())
        name = F.lower(_pick(words, _draw(seed, F.lit(0), n)))
        script = group.split(":")[0]
        more = SYLLABLES[script]
        if attempt:  # a second name once the short list is taken
            name = F.concat(name, F.lit("-"), *[_pick(more, _draw(seed, F.lit(i), len(more.split()))) for i in range(1, 2 + attempt)])
        out = F.when(kind == f"given:{group}", name).otherwise(out)
    return out


def _format(kind: Column, value: Column, new: Column) -> Column:
    """A surrogate in the spelling of the mention: its punctuation, or its case."""

    def put(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substring(value, F.lit(1), i + 1), "[^0-9A-Za-z]", ""))
        return F.when(c.rlike("[0-9A-Za-z]"), F.substring(new, before, F.lit(1))).otherwise(c)

    spelled = F.array_join(F.transform(F.filter(F.split(value, ""), lambda c: c != ""), put), "")
    title = F.initcap(F.replace(new, F.lit("-"), F.lit(" ")))
    name = F.when((F.upper(value) == value) & (F.length(value) > 1), F.upper(new)).otherwise(F.replace(title, F.lit(" "), F.lit("-")))
    return F.when(kind.isin("phone", "card", "ssn", "iban"), spelled).when(kind.rlike("^(?:given|family)"), name).when((kind == "email") & (F.upper(value) == value), F.upper(new)).otherwise(new)


def assign(atoms: DataFrame, key: str, scratch: common.Scratch) -> DataFrame:
    """kind, norm and new for each different atom; all new ones of a kind are distinct and none occurs in the table.

    After ROUNDS attempts the form of a kind has too few surrogates left for its atoms: the last ones get the kind's
    name and 128 bits of a hash instead."""
    spark = atoms.sparkSession
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    every = scratch.write(atoms.groupBy("kind", "norm").agg(F.lit(1).alias("one")).drop("one"), "atoms")
    real = every.select("kind", F.col("norm").alias("new"))
    open_, taken = every, None
    for attempt in range(ROUNDS + 1):
        drawn = open_.repartition(tasks, "kind", "norm").select("kind", "norm", surrogate(F.col("kind"), F.col("norm"), key, attempt).alias("new"))
        won = drawn.groupBy("kind", "new").agg(F.min("norm").alias("norm")).join(real, ["kind", "new"], "left_anti")
        if taken is not None:
            won = won.join(taken, ["kind", "new"], "left_anti")
        won = scratch.write(won.select("kind", "norm", "new"), "won")
        taken = won if taken is None else taken.unionByName(won)
        open_ = open_.join(won, ["kind", "norm"], "left_anti")
        if open_.isEmpty():
            break
        open_ = scratch.write(open_, "open")
    return taken


def replace(docs: DataFrame, key: str, text_col: str = "text", count_col: str | None = None) -> DataFrame:
    """docs with the mentions in the text column replaced, all else as it is; count_col, if given, counts them.

    Null texts stay null, texts without a mention stay as they are, equal texts change equally, whatever the
    further columns are called. A table without a mention, or without a row, comes back unchanged.
    """
    text = docs[text_col].cast("string")
    # cheap tests that every mention passes, so that the whole pattern is seldom tried
    hint = text.rlike("[0-9@]") | ((F.contains(text, F.lit("=")) | F.contains(text, F.lit(":"))) & text.rlike(SECRET_LABEL)) | text.rlike(TITLE_START + TITLE + " ") | F.contains(text, F.lit("AKIA")) | F.contains(text, F.lit("ASIA"))
    hit = F.coalesce(hint & text.rlike(MENTION), F.lit(False))
    scratch = common.Scratch(docs.sparkSession, "pii")
    place = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in (text_col, count_col)}
    void = [c for c in place if docs.schema[c].dataType == T.NullType()]
    # found once and written: the segments are worked out for these texts alone
    dirty = docs.where(hit).select(text.alias("text"), F.sha2(text, 256).alias("k"), *[docs[c].alias(n) for c, n in place.items() if c not in void])
    dirty = scratch.write(dirty, "dirty")
    # the pattern costs far more than the bytes it reads, so its tasks aren't joined into fewer ones
    tasks = 4 * docs.sparkSession.sparkContext.defaultParallelism
    segs = dirty.select("k", "text").dropDuplicates(["k"]).repartition(tasks, "k").select("k", segments(F.col("text")).alias("segs"))
    segs = scratch.write(segs, "segments").select("k", "segs", names_of(F.col("segs")).alias("names"))
    segs = scratch.write(segs.select("k", coreferent(F.col("segs"), F.col("names")).alias("segs")), "coreferent")
    found = segs.select("k", F.posexplode("segs").alias("pos", "seg")).where("seg.kind is not null").select("k", "pos", F.col("seg.kind").alias("kind"), F.col("seg.value").alias("value"))
    found = scratch.write(found.withColumn("norm", norm(F.col("kind"), F.col("value"))), "found")
    surrogates = assign(found, key, scratch)
    put = found.join(surrogates, ["kind", "norm"]).select("k", "pos", _format(F.col("kind"), F.col("value"), F.col("new")).alias("new"))
    by_text = segs.join(put.groupBy("k").agg(F.map_from_entries(F.collect_list(F.struct("pos", "new"))).alias("news")), "k", "left")
    pieces = F.transform("segs", lambda s, i: F.concat(s["pre"], F.coalesce(F.try_element_at("news", i), s["value"])))
    by_text = by_text.select("k", F.array_join(pieces, "").alias("new_text"), F.coalesce(F.size("news"), F.lit(0)).alias("mentions"))
    joined = dirty.join(by_text, "k")
    counted = [count_col] if count_col and count_col not in docs.columns else []

    def of(kind: str, column: str) -> Column:
        if column == text_col:
            return (F.col("new_text") if kind == "dirty" else text).alias(column)
        if column == count_col:
            return (F.col("mentions") if kind == "dirty" else F.lit(0)).alias(column)
        return (docs[column] if kind == "clean" else F.lit(None) if column in void else F.col(place[column])).alias(column)

    columns = [*docs.columns, *counted]
    clean = docs.where(~hit).select(*[of("clean", c) for c in columns])
    return clean.unionByName(joined.select(*[of("dirty", c) for c in columns]))
