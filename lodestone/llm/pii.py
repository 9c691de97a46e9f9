"""Surrogates for personal data, with DataFrame functions alone.

One pattern finds e-mail addresses, telephone numbers, card and other long numbers, social security numbers, IBANs, IPv4 and IPv6 addresses, secrets and names after a title.
Each entity has a canonical form (digits of a number, lower-case address, word of a name), and all its mentions get the same surrogate: coreference
stays.  A given name after a title without a gender takes the gender that most mentions of the corpus show for it.  A full name that a text has once with a title is
replaced there without one too; a name that never has a title isn't found.

A surrogate is drawn by a keyed hash of type, form and attempt and keeps type and format: punctuation and digit groups of the mention, length
and Luhn validity of numbers, country codes, letter case, script and alphabet, gender of names.  Of a mail domain only its public end stays (the last label,
or two as in co.uk and the reserved example.com); a label gets the same surrogate wherever it stands before the same rest.

Collision checks keep distinct entities distinct: a draw that equals an entity of the corpus, or a surrogate already given, or the draw of an entity with a smaller
form, is drawn again with the next attempt, until none is left.  Names grow by syllables with the attempt, so their space never ends.  Only entities are shuffled, and texts with entities once.

The key is the setting ``spark.lodestone.pii.key`` of the session; without one a fixed development key is used, which protects nothing.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import cut, drop_cut, table

KEY_SETTING = "spark.lodestone.pii.key"
DEVELOPMENT_KEY = "development"
#: Attempts before draws may equal other entities of the corpus (never surrogates given), and before the space of a format counts as used up.
CROWDED, FULL = 32, 64
#: Labels of a mail domain before its last one (a domain name has 127 at most), and hyphenated parts of a name after its first.  Java's patterns recurse once for each repeat of a group, so every group has a bound.
LABELS, HYPHENS = 126, 7
#: Mentions and entities are small rows with much to do, so tasks are made by their number and not by their bytes.
ROWS_A_TASK = 4000

# Titles by the gender that they show, and letters, given names and syllables of surrogate names by script.
TITLES_M = ["Mr", "Herr", "Herrn", "Monsieur", "Señor", "Sr", "Don", "Signor", "г-н", "господин", "Господин", "Κύριος", "κ"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Señorita", "Sra", "Srta", "Doña", "Signora", "г-жа", "госпожа", "Госпожа", "Κυρία", "κα"]
TITLES_N = ["Dr", "Prof", "Professor"]
GIVEN = {
    "latin": {"m": ["Alban", "Bruno", "Carl", "Denis", "Emil", "Felix", "Gustav", "Hugo", "Ivor", "Jonas", "Konrad", "Lars", "Martin", "Nils", "Oscar", "Paul"], "f": ["Anna", "Berta", "Clara", "Dora", "Elena", "Flora", "Greta", "Helena", "Irma", "Julia", "Klara", "Laura", "Marta", "Nina", "Olga", "Paula"]},
    "cyrillic": {"m": ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Иван", "Кирилл"], "f": ["Алла", "Белла", "Вера", "Галина", "Дарья", "Елена", "Инна", "Клара"]},
    "greek": {"m": ["Ανδρέας", "Γιώργος", "Δημήτρης", "Ηλίας", "Κώστας", "Λεωνίδας", "Μάριος", "Νίκος"], "f": ["Άννα", "Δήμητρα", "Ελένη", "Ζωή", "Ειρήνη", "Κατερίνα", "Μαρία", "Σοφία"]},
}
SYLLABLES = {
    "latin": ["ba", "den", "fi", "gor", "hal", "kem", "lu", "mar", "nor", "pel", "ro", "san", "tor", "ul", "ven", "wil"],
    "cyrillic": ["ба", "вел", "гор", "дан", "жи", "зор", "ка", "лем", "мар", "нов", "пе", "рон", "сав", "тол", "фи", "яр"],
    "greek": ["βα", "γκο", "δελ", "ζα", "θεο", "κα", "λεμ", "μαρ", "νι", "παπ", "ρου", "σαλ", "τζο", "φιλ", "χατ", "ψα"],
}

# Letters to draw from for each script that has no Latin case, and the second labels that end a public suffix under a country.
ALPHABETS = {
    "IsCyrillic": "абвгдежзиклмнопрстуфхцчшэюя", "IsGreek": "αβγδεζηθικλμνξοπρστυφχψω", "IsHebrew": "אבגדהוזחטיכלמנסעפצקרשת", "IsArabic": "ابتثجحخدذرزسشصضطظعغفقكلمنهوي", "IsDevanagari": "कखगघचछजझटठडढतथदधनपफबभमयरलवशसह", "IsHan": "王李張劉陳楊黃趙吳周徐孫馬朱胡郭何高林羅",
    "IsHiragana": "あいうえおかきくけこさしすせそたちつてと", "IsKatakana": "アイウエオカキクケコサシスセソタチツテト", "IsHangul": "가나다라마바사아자차카타파하거너더러머버", "IsThai": "กขคงจชซญดตถทธนบปผพฟมยรลวสหอ", "IsArmenian": "աբգդեզէըթժիլխծկհձղճմյնշոչպջռսվտրցփքօֆ", "IsGeorgian": "აბგდევზთიკლმნოპჟრსტუფქღყშჩცძწჭხჯჰ",
}
SECOND = ["co", "com", "org", "net", "ac", "gov", "edu", "ne", "or"]

_L, _N = r"\p{L}", r"\p{N}"
_HEX = "[0-9A-Fa-f]{1,4}"
_NAME = r"\p{Lu}(?:['’]\p{Lu})?[\p{L}\p{M}]+"
_TITLE = "|".join(sorted([*TITLES_M, *TITLES_F, *TITLES_N], key=len, reverse=True))
_FIRST = "".join(sorted({t[0] for t in [*TITLES_M, *TITLES_F, *TITLES_N]}))
_BEFORE = rf"(?<![{_L}{_N}])"
_SECRET = "(?i:token|secret|password|passwd|api_key|apikey|api-key|access_key)[\"']? {0,2}[=:] {0,2}[\"']?"
#: Each begins with a set of first characters, so that most places of a text are left at once.
PATTERNS = [
    ("secret", rf"(?=[tspaTSPA]){_BEFORE}{_SECRET}[A-Za-z0-9_\-+/.]{{8,}}+"),
    ("email", rf"(?=[{_L}{_N}._%+\-])(?<![{_L}{_N}._%+\-])[{_L}{_N}._%+\-]++@[{_L}{_N}\-]++(?:\.[{_L}{_N}\-]++){{0,{LABELS}}}\.\p{{L}}{{2,}}"),
    ("ip", rf"(?=[0-9])(?<![{_L}{_N}.])(?:(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)\.){{3}}(?:25[0-5]|2[0-4]\d|1\d\d|\d?\d)(?![{_N}]|\.[{_N}])"),
    ("ipv6", rf"(?=[0-9A-Fa-f])(?<![{_L}{_N}:.])(?:(?:{_HEX}:){{7}}{_HEX}|(?=[0-9A-Fa-f]*[0-9])(?:{_HEX}:){{1,6}}(?::{_HEX}){{1,6}})(?![{_L}{_N}:])"),
    ("phone", rf"(?=[0-9+(])(?:(?<![{_L}{_N}+])\+(?=(?:[ .\-()]{{0,2}}\d){{8,15}}(?![ .\-]?\d))\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{1,5}}(?:[ .\-]\d{{2,8}}){{1,4}}(?![{_N}]|[.\-][0-9])|(?<![{_L}{_N}+])\+\d{{1,3}}[ .\-]?(?:\(\d{{1,4}}\)[ .\-]?)?\d{{2,4}}(?<sep>[ .\-])\d{{2,4}}(?:\k<sep>\d{{2,4}}){{0,3}}(?![{_N}]|[.\-][0-9])|(?<![{_L}{_N}+])\+\d{{8,15}}(?![{_N}])|{_BEFORE}\(\d{{3}}\) ?\d{{3}}-\d{{4}}(?![{_N}])|(?<![{_L}{_N}\-.])\d{{3}}[.\-]\d{{3}}[.\-]\d{{4}}(?![{_N}]))"),
    ("ssn", rf"(?=[0-9])(?<![{_L}{_N}\-])\d{{3}}-\d{{2}}-\d{{4}}(?![{_N}\-])"),
    ("iban", rf"(?=[A-Z]){_BEFORE}[A-Z]{{2}}\d{{2}}(?: ?[A-Z0-9]{{4}}){{2,7}}(?: ?[A-Z0-9]{{1,3}})?(?![{_L}{_N}])"),
    ("card", rf"(?=[0-9]){_BEFORE}\d(?:[ \-]?\d){{12,18}}(?![{_L}{_N}])"),
    ("secret", rf"(?=[0-9a-gA-GsS]){_BEFORE}(?i:[0-9a-f]{{32,128}}|AKIA[0-9A-Z]{{16}}|gh[pousr]_[A-Za-z0-9]{{36}}|sk-[A-Za-z0-9]{{20,64}})(?![{_L}{_N}])"),
    ("name", rf"(?=[{_FIRST}]){_BEFORE}(?:{_TITLE})\.? {_NAME}(?:-{_NAME}){{0,{HYPHENS}}}(?: (?!(?:{_TITLE})\.? ){_NAME}(?:-{_NAME}){{0,{HYPHENS}}}){{0,2}}(?![{_L}{_N}])"),
]
PATTERN = "|".join(f"(?:{p})" for _, p in PATTERNS)
#: Every entity holds a digit or an @, or follows a title, or a secret's name.
MAYBE = [r"[0-9@]", rf"(?=[{_FIRST}])(?:{_TITLE})\.? \p{{Lu}}", rf"(?=[tspaTSPA]){_SECRET}"]


def _hits(text: Column) -> Column:
    """All matches in a text; most texts are passed over by simpler patterns."""
    maybe = reduce(lambda a, b: a | b, [F.regexp_like(text, F.lit(p)) for p in MAYBE])
    return F.when(maybe, F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.array().cast("array<string>"))


def _kind(hit: Column) -> Column:
    """The type of a match: the first pattern that matches all of it."""
    whole = [(k, F.regexp_like(hit, F.lit(f"^(?:{p})$"))) for k, p in PATTERNS]
    return reduce(lambda rest, x: F.when(x[1], x[0]).otherwise(rest), reversed(whole), F.lit("secret"))


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def _script(word: Column) -> Column:
    return F.when(word.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(word.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def _hash(key: str, *parts: Column) -> Column:
    """256 hexadecimal digits of a keyed hash."""
    message = F.concat_ws("\u0001", F.lit(key), *parts)
    inner = F.sha2(message, 256)
    return F.concat(*[F.sha2(F.concat(F.lit(f"{key}\u0002{k}"), inner), 256) for k in range(4)])


def _byte(h: Column, i: Column) -> Column:
    """The i-th number from 0 to 255 of a hash; after 128 they begin again."""
    return F.conv(F.substring(h, F.pmod(i, F.lit(128)) * 2 + 1, F.lit(2)), 16, 10).cast("int")


def _letters(x: Column) -> Column:
    """The characters of a string, in one pass; a substring for each place would take time in the square of the length."""
    return F.regexp_extract_all(x, F.lit("(?s)."), F.lit(0))


def _chars(x: Column) -> Column:
    return F.transform(_letters(x), lambda c, i: F.struct((i + 1).alias("i"), c.alias("c")))


def _pick(letters: str, n: Column) -> Column:
    return F.substring(F.lit(letters), F.pmod(n, F.lit(len(letters))) + 1, F.lit(1))


def _letter(c: Column, n: Column) -> Column:
    """A letter of the script and case of ``c``; scripts without letters of their own here become Latin."""
    lower = reduce(lambda rest, x: F.when(c.rlike(rf"\p{{{x[0]}}}"), _pick(x[1], n)).otherwise(rest), ALPHABETS.items(), _pick("abcdefghijklmnopqrstuvwxyz", n))
    return F.when(c.rlike(r"\p{Lu}"), F.upper(lower)).otherwise(lower)


def _same_shape(x: Column, h: Column) -> Column:
    """Digits for digits, letters for letters of the same script and case; a string of hexadecimal digits stays one."""
    hexes = x.rlike("^[0-9a-f]{16,}$") & x.rlike("[a-f]")
    upper = x.rlike("^[0-9A-F]{16,}$") & x.rlike("[A-F]")
    mixed = x.rlike("^[0-9a-fA-F]{16,}$")

    def plain(c: Column, n: Column) -> Column:
        return (
            F.when(c.rlike(r"\p{N}"), _pick("0123456789", n)).when(c.rlike("[A-Z]"), _pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", n)).when(c.rlike("[a-z]"), _pick("abcdefghijklmnopqrstuvwxyz", n))
            .when(c.rlike(r"\p{L}"), _letter(c, n)).otherwise(c)
        )

    def both(c: Column, n: Column) -> Column:
        return F.when(c.rlike("[A-F]"), _pick("ABCDEF", n)).when(c.rlike("[a-f]"), _pick("abcdef", n)).otherwise(_pick("0123456789", n))

    each = lambda one: F.array_join(F.transform(_letters(x), lambda c, i: one(c, _byte(h, i + 1))), "")
    # the string is judged once and not for each of its characters
    return F.when(hexes, each(lambda c, n: _pick("0123456789abcdef", n))).when(upper, each(lambda c, n: _pick("0123456789ABCDEF", n))).when(mixed, each(both)).otherwise(each(plain))


def _luhn(d: Column) -> Column:
    """Sum of a digit string modulo 10 by Luhn's rule, the last digit counting once."""

    def weigh(i: Column) -> Column:
        n = F.substring(d, F.length(d) - i, F.lit(1)).cast("int")
        twice = n * 2
        return F.when(i % 2 == 1, twice - F.when(twice > 9, 9).otherwise(0)).otherwise(n)

    return F.aggregate(F.sequence(F.lit(0), F.length(d) - 1), F.lit(0), lambda s, i: s + weigh(i)) % 10


def _domain(domain: Column, key: str) -> Column:
    """Surrogate labels before the public end of a domain, each by a hash of itself and what follows it."""
    labels = F.split(domain, r"\.")
    reserved = F.element_at(labels, -1).isin("com", "net", "org") & (F.get(labels, F.size(labels) - 2) == "example")
    public = F.when(reserved, 2).when((F.size(labels) > 2) & (F.length(F.element_at(labels, -1)) == 2) & F.element_at(labels, -2).isin(SECOND), 2).otherwise(1)
    return F.array_join(F.transform(labels, lambda x, i: F.when(i < F.size(labels) - public, _same_shape(x, _hash(key, F.lit("domain"), F.array_join(F.slice(labels, i + 1, F.size(labels)), ".")))).otherwise(x)), ".")


def _draw(kind: Column, form: Column, attempt: int, h: Column, key: str) -> Column:
    """The surrogate form of an entity, by its hash ``h``."""
    digits = F.array_join(F.transform(_chars(form), lambda c: F.when(c["i"] == 1, _pick("123456789", _byte(h, c["i"]))).otherwise(_pick("0123456789", _byte(h, c["i"])))), "")
    card = F.concat(F.substring(form, 1, 1), F.substring(digits, F.lit(2), F.length(form) - 2))
    check = F.pmod(10 - _luhn(F.concat(card, F.lit("0"))), F.lit(10))
    odd = F.pmod(check + 1 + _byte(h, F.lit(100)) % 9, F.lit(10))
    card = F.concat(card, F.when(_luhn(form) == 0, check).otherwise(odd).cast("string"))
    private = F.regexp_extract(form, r"^(10\.|127\.|192\.168\.|169\.254\.|172\.(?:1[6-9]|2\d|3[01])\.)", 1)
    octets = [F.when(F.lit(k == 0), _byte(h, F.lit(k)) % 126 + 11 + F.when(_byte(h, F.lit(k)) % 126 + 11 == 127, 1).otherwise(0)).otherwise(_byte(h, F.lit(k))).cast("string") for k in range(4)]
    kept = F.size(F.split(private, r"\.")) - 1
    ip = F.concat(private, F.array_join(F.slice(F.array(*octets), kept + 1, 4 - kept), "."))
    local, domain = F.substring_index(form, "@", 1), F.substring_index(form, "@", -1)
    email = F.concat(_same_shape(local, h), F.lit("@"), _domain(domain, key))
    scope = F.regexp_extract(form, "^(fe[89ab][0-9a-f]|f[cd][0-9a-f]{2}|ff[0-9a-f]{2})(?=:)", 1)
    ipv6 = F.array_join(F.transform(_chars(form), lambda c: F.when((c["i"] > F.length(scope)) & c["c"].rlike("[0-9a-f]"), F.when((c["i"] == 1) | (F.substring(form, c["i"] - 1, F.lit(1)) == ":"), _pick("123456789", _byte(h, c["i"]))).otherwise(_pick("0123456789abcdef", _byte(h, c["i"])))).otherwise(c["c"])), "")
    phone = F.when(form.startswith("+"), F.concat(F.regexp_extract(form, r"^(\+\d*) ", 1), F.lit(" "), F.substring(digits, F.length(F.regexp_extract(form, r"^(\+\d*) ", 1)) + 2, F.length(form)))).otherwise(digits)
    iban = F.concat(F.substring(form, 1, 2), _same_shape(F.substring(form, F.lit(3), F.length(form)), h))
    word = F.substring_index(form, ":", -1)
    names = []
    for script, syl in SYLLABLES.items():
        s = [F.element_at(F.array(*map(F.lit, syl)), _byte(h, F.lit(k)) % len(syl) + 1) for k in range(4 + attempt)]
        family = F.initcap(F.concat(*s[: 3 + attempt]))
        for g in ("m", "f"):
            pool = GIVEN[script][g]
            given = [F.element_at(F.array(*map(F.lit, pool)), _byte(h, F.lit(k)) % len(pool) + 1) for k in (5, 6)]
            more = [F.lit("")] if attempt == 0 else [F.lit("-"), given[1]] if attempt == 1 else [F.lit("-"), F.initcap(F.concat(*s[:attempt]))]
            names.append(((kind == "given") & (_script(word) == script) & (F.substring(form, 1, 1) == g), F.concat(F.lit(f"{g}:"), given[0], *more)))
        names.append(((kind == "family") & (_script(word) == script), F.concat(F.lit("n:"), family)))
    choice = [(kind == "card", card), (kind == "ssn", digits), (kind == "phone", phone), (kind == "ip", ip), (kind == "ipv6", ipv6), (kind == "email", email), (kind == "iban", iban), *names]
    return reduce(lambda rest, x: F.when(x[0], x[1]).otherwise(rest), reversed(choice), _same_shape(form, h))


def _body(hit: Column) -> Column:
    """A mention of a name without its title."""
    return F.regexp_replace(hit, r"^\S+ ", "")


def _units(kind: Column, hit: Column) -> Column:
    """The entities of a match as an array of (kind, form): one, or for a name the given names (by gender, ? where the title shows none) and the family name."""
    title = F.regexp_extract(hit, r"^(\S+?)\.? ", 1)
    gender = F.when(title.isin(TITLES_F), "f").when(title.isin(TITLES_M), "m").otherwise("?")
    words = F.split(_body(hit), "[ -]")
    given = F.transform(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), lambda w: F.struct(F.lit("given").alias("kind"), F.concat(gender, F.lit(":"), w).alias("form")))
    family = F.struct(F.lit("family").alias("kind"), F.concat(F.lit("n:"), F.element_at(words, -1)).alias("form"))
    code = F.regexp_extract(hit, r"^\+(\d{1,3})(?=[ .(-])", 1)
    phone = F.when(code != "", F.concat(F.lit("+"), code, F.lit(" "), _digits(F.regexp_replace(hit, r"^\+\d{1,3}", "")))).otherwise(_digits(hit))
    value = F.regexp_replace(hit, f"^{_SECRET}", "")
    form = F.when(kind == "secret", value).when(kind.isin("email", "ipv6"), F.lower(hit)).when(kind == "phone", phone).when(kind.isin("card", "ssn"), _digits(hit)).when(kind == "iban", F.regexp_replace(hit, " ", "")).otherwise(hit)
    single = F.array(F.struct(kind.alias("kind"), form.alias("form")))
    return F.when(kind == "name", F.concat(given, F.array(family))).otherwise(single)


def _written(kind: Column, hit: Column, forms: Column) -> Column:
    """The mention with its surrogates: their characters in the mention's punctuation, their words after its title."""
    only = forms[0]
    into = F.regexp_replace(only, r"^(\+\d*) ", "$1")
    filled = F.aggregate(
        _chars(hit), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.struct(F.concat(s["out"], F.when(c["c"].rlike("[0-9A-Za-z]"), F.substring(F.regexp_replace(into, r"^\+", ""), s["at"], F.lit(1))).otherwise(c["c"])).alias("out"), (s["at"] + F.when(c["c"].rlike("[0-9A-Za-z]"), 1).otherwise(0)).alias("at")),
        lambda s: s["out"],
    )
    words = F.transform(forms, lambda f: F.substring_index(f, ":", -1))
    joints = F.regexp_extract_all(_body(hit), F.lit("[ -]"), F.lit(0))
    name = F.concat(F.regexp_extract(hit, r"^(\S+ )", 1), F.array_join(F.transform(words, lambda w, i: F.concat(w, F.coalesce(F.get(joints, i), F.lit("")))), ""))
    cased = F.when(F.length(only) == F.length(hit), F.array_join(F.zip_with(_letters(hit), _letters(only), lambda a, b: F.when(a.rlike(r"\p{Lu}"), F.upper(b)).otherwise(b)), "")).otherwise(only)
    return (
        F.when(kind == "name", name).when(kind.isin("card", "ssn", "phone", "iban"), filled).when(kind == "email", cased).when((kind == "ipv6") & hit.rlike("[A-F]"), F.upper(only))
        .when(kind == "secret", F.concat(F.regexp_extract(hit, f"^({_SECRET})?", 0), only)).otherwise(only)
    )


def surrogates(entities: DataFrame, key: str = DEVELOPMENT_KEY) -> DataFrame:
    """(kind, form, surrogate) of distinct ``entities`` (kind, form); no two of a kind share a surrogate, and none is an entity of its kind.

    Where a format is so crowded that CROWDED attempts found no such form, a surrogate may be another entity's form, but not its own and not another's surrogate.  Beyond FULL
    attempts the format has too few forms, which is an error: no entity ever loses its format or stays as it is."""
    entities = cut(entities, "pii-entities")
    tasks = -(-entities.count() // ROWS_A_TASK) or 1
    left, done, attempt = entities, None, 0
    while True:
        # the hash is written: as an expression it would stand in the filter below, and be made again for each character of a form
        keyed = cut(left.withColumn("h", _hash(key, F.col("kind"), F.col("form"), F.lit(str(attempt)))), "pii-keyed")
        drawn = keyed.repartition(tasks, "kind", "form").select("kind", "form", _draw(F.col("kind"), F.col("form"), attempt, F.col("h"), key).alias("surrogate")).where("form <> surrogate")
        real = entities.select("kind", F.col("form").alias("surrogate"))
        free = drawn.join(real, ["kind", "surrogate"], "left_anti") if attempt < CROWDED else drawn
        if done is not None:
            free = free.join(done.select("kind", "surrogate"), ["kind", "surrogate"], "left_anti")
        won = free.groupBy("kind", "surrogate").agg(F.min("form").alias("form")).select("kind", "form", "surrogate")
        before = [x for x in (done, left, keyed) if x is not None and x is not entities]
        done = cut(won if done is None else done.unionByName(won), "pii-surrogates")
        left = cut(entities.join(done, ["kind", "form"], "left_anti"), "pii-left")
        for x in before:
            drop_cut(x)
        if not left.take(1):
            drop_cut(left)
            drop_cut(entities)
            return done
        attempt += 1
        if attempt >= FULL:
            raise RuntimeError("some kind of entity has more forms in the corpus than its format allows surrogates for")


def genders(units: DataFrame) -> DataFrame:
    """(word, shown): the gender that most mentions with a gendered title show for a given name; ties go to f."""
    shown = units.where("kind = 'given'").select(F.substring_index("form", ":", -1).alias("word"), F.substring("form", 1, 1).alias("g")).where("g <> '?'")
    return shown.groupBy("word").agg(F.sum(F.when(F.col("g") == "f", 1).otherwise(-1)).alias("f")).select("word", F.when(F.col("f") >= 0, "f").otherwise("m").alias("shown"))


def replace_pii(docs: DataFrame, key: str | None = None) -> DataFrame:
    """``docs`` with surrogates in its column text; other columns as they are (a length that a column may hold isn't counted again).

    Null and empty texts, and texts without entities, stay as they are.  Repeated rows get equal texts, and an entity gets the same surrogate in
    all documents; another ``key`` (from the session's setting unless given) gives others.  A very long text is one row for Spark's functions, which hold it a few times.  Of entities that
    draw the same surrogate the smallest form gets it, the others draw again."""
    key = key or docs.sparkSession.conf.get(KEY_SETTING, None) or DEVELOPMENT_KEY
    columns = [f.name for f in docs.schema.fields]
    text = next(c for c in columns if c.lower() == "text")
    tag, added, named = "pii_key", "pii_new", "pii_named"
    while {tag, added, named} & {c.lower() for c in columns}:
        tag, added, named = f"{tag}_", f"{added}_", f"{named}_"
    hits = _hits(F.col(f"`{text}`"))
    mentions = cut(docs.select(F.col(f"`{text}`").alias("t")).where(F.col("t").isNotNull()).select(F.sha2("t", 256).alias("h"), _hits(F.col("t")).alias("hits")).where(F.size("hits") > 0).dropDuplicates(["h"]), "pii-mentions")
    tasks = -(-mentions.count() // ROWS_A_TASK) or 1
    hit = mentions.select(F.explode("hits").alias("hit")).distinct().repartition(tasks, "hit").withColumn("kind", _kind(F.col("hit")))
    unit = cut(hit.select("hit", F.col("kind").alias("whole"), F.posexplode(_units(F.col("kind"), F.col("hit"))).alias("pos", "u")).select("hit", "whole", "pos", F.col("u.kind").alias("kind"), F.col("u.form").alias("form")), "pii-units")
    open_ = (F.col("kind") == "given") & F.col("form").startswith("?:")
    word = F.substring_index("form", ":", -1)
    drawn = F.when(F.pmod(F.xxhash64("word"), F.lit(2)) == 0, "m").otherwise("f")
    decided = unit.where(open_).withColumn("word", word).join(genders(unit), "word", "left").withColumn("form", F.concat(F.coalesce("shown", drawn), F.lit(":"), F.col("word")))
    open_units, unit = unit, cut(unit.where(~open_).unionByName(decided.select(*unit.columns)), "pii-decided")
    drop_cut(open_units)
    given = surrogates(unit.select("kind", "form").distinct(), key)
    forms = unit.join(given, ["kind", "form"]).groupBy("hit", "whole").agg(F.array_sort(F.collect_list(F.struct("pos", "surrogate"))).alias("s")).repartition(tasks, "hit")
    written = forms.select("hit", F.when((F.col("whole") == "name") & (F.size("s") > 1), _body(F.col("hit"))).alias("name"), _written(F.col("whole"), F.col("hit"), F.transform("s", lambda x: x["surrogate"])).alias("new"))
    found = mentions.select("h", F.posexplode("hits").alias("pos", "hit")).join(written, "hit")
    bare = F.array_sort(F.collect_set(F.when(F.col("name").isNotNull(), F.struct((-F.length("name")).alias("order"), F.col("name"), _body(F.col("new")).alias("new")))))
    new = found.groupBy("h").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "new"))), lambda x: x["new"]).alias("new"), bare.alias("named"))
    keyed = docs.withColumn(tag, F.when(F.size(hits) > 0, F.sha2(F.col(f"`{text}`"), 256)))
    plain = keyed.where(F.col(tag).isNull()).select(*[F.col(f"`{c}`") for c in columns])
    some = keyed.where(F.col(tag).isNotNull()).join(new.select(F.col("h").alias(tag), F.col("new").alias(added), F.col("named").alias(named)), tag)
    again = lambda x: F.aggregate(F.col(named), x, lambda s, n: F.regexp_replace(s, F.concat(F.lit(rf"{_BEFORE}\Q"), n["name"], F.lit(rf"\E(?![{_L}{_N}])")), n["new"]))
    parts = F.transform(F.split(F.col(f"`{text}`"), PATTERN, -1), lambda p: again(p))
    made = F.array_join(F.transform(parts, lambda p, i: F.concat(p, F.coalesce(F.get(F.col(added), i), F.lit("")))), "")
    changed = some.select(*[(made if c == text else F.col(f"`{c}`")).alias(c) for c in columns])
    return plain.unionByName(changed)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents with surrogates for personal data."""
    return replace_pii(table(spark, sf_dir, "documents").select("doc_id", "text"))
