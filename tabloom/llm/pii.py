"""Personal data replaced by keyed surrogates, in DataFrame functions only.

Found are e-mail addresses, quoted secrets and well-known key forms, IPv4 addresses, phone numbers, payment card
numbers (right issuer digit and Luhn sum), US social security numbers, and names behind a title (the title tells the
gender). A match is cut into units (an address into mailbox and domain, a name into given and family name), and each
distinct unit of the corpus gets one surrogate:

* keyed: a SHA-256 of key, kind and unit drives every choice; without the key nothing leads back;
* type-consistent: cards keep issuer digit and a right Luhn sum, addresses stay addresses below a reserved domain,
  phones keep country code and layout, IPs stay valid, secrets keep length and letter classes, names keep gender
  and script (Latin or Cyrillic);
* coreferent: a number written in two layouts, or a family name with and without given name, keeps one surrogate;
* distinct: surrogates that two units share are drawn again until none is left, and in the first draws also those
  that are themselves units of the corpus; the smallest unit of a clash keeps its draw.

Texts are scanned once for units and once for the replacement. Units are few beside the text; only texts with a
possible match are joined with their surrogates, and equal texts share one entry of that join.

Defined cases: null stays null; texts without matches stay as they are; repeated rows give repeated results; an
empty table gives an empty table; other columns pass through, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabloom.functions.columns import col
from tabloom.llm.common import bind, free_name, stored

# Titles by gender.
TITLES_MALE = ("Mr", "Herr", "Monsieur", "Señor", "Sr", "Господин", "г-н")
TITLES_FEMALE = ("Mrs", "Ms", "Miss", "Frau", "Madame", "Mme", "Mlle", "Señora", "Sra", "Госпожа", "г-жа")
_TITLE = "(?:" + "|".join(sorted(TITLES_MALE + TITLES_FEMALE, key=len, reverse=True)) + ")"
_NAME = r"\p{Lu}[\p{L}’'-]+"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"

EMAIL = r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)*\.\p{L}{2,}"
SECRET = (
    r"(?<=[=:] ?[\"'])[0-9A-Za-z_+/.~-]{16,}(?=[\"'])"
    r"|(?<![0-9A-Za-z])(?:A[KS]IA[0-9A-Z]{16}|gh[pousr]_[0-9A-Za-z]{36,}|sk-[0-9A-Za-z]{20,})(?![0-9A-Za-z])"
)
IP = rf"(?<![\d.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\d|\.\d)"
PHONE = (
    r"(?<![\d+])\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}(?!\d)"
    r"|(?<![\d+])\(\d{3}\)[ .-]?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d.-]\d|\d)"
)
CARD = r"(?<![\d.,+-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})(?!\d)"
SSN = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
PERSON = rf"(?<!\p{{L}}){_TITLE}\.? {_NAME}(?: {_NAME})?"
ANY = "|".join((EMAIL, SECRET, IP, PHONE, CARD, SSN, PERSON))
#: Every match of ANY lies in a text with a match of this cheaper pattern.
HINT = rf"@|\d[\d.)-]|[=:] ?[\"']|A[KS]IA|gh[pousr]_|sk-|{_TITLE}\.? \p{{Lu}}"

DIGIT_KINDS = ("phone", "card", "ssn")
_CONSONANTS, _VOWELS = "bdfgklmnprstvz", "aeiou"
_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS = "бвгдзклмнпрст", "аеиоу"


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, r"[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a string of digits."""

    def add(total, i):
        d = F.substring(digits, -i, 1).cast("int")
        doubled = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 0, doubled).otherwise(d)

    return F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), add)


def _unit(lead: Column, kind, canon: Column, form: Column, scope=None) -> Column:
    kind = kind if isinstance(kind, Column) else F.lit(kind)
    scope = F.lit("") if scope is None else scope
    return F.struct(
        lead.alias("lead"), kind.cast("string").alias("kind"), scope.alias("scope"), canon.alias("canon"), form.alias("form")
    )


def _units_of(gap: Column, m: Column) -> Column:
    """The units of one match, the text before it in the first unit's lead. A null kind stays as it is."""
    domain = F.lower(F.substring_index(m, "@", -1))
    email = F.array(
        _unit(gap, "email", F.lower(m), F.substring_index(m, "@", 1), domain), _unit(F.lit("@"), "domain", domain, domain)
    )
    title = F.regexp_extract(m, rf"^{_TITLE}\.? ", 0)
    names = F.split(F.substr(m, F.length(title) + 1), " ")
    bare = F.regexp_replace(title, r"\.? $", "")
    script = F.when(F.rlike(names[0], F.lit(r"\p{IsCyrillic}")), F.lit("cyrillic")).otherwise(F.lit("latin"))
    gender = F.when(bare.isin(*TITLES_MALE), F.lit("male")).otherwise(F.lit("female"))
    family = F.concat_ws("-", F.lit("family"), script)
    given = F.concat_ws("-", F.lit("given"), gender, script)
    one = F.array(_unit(F.concat(gap, title), family, names[0], names[0]))
    two = F.array(_unit(F.concat(gap, title), given, names[0], names[0]), _unit(F.lit(" "), family, F.get(names, 1), F.get(names, 1)))
    numbers = _digits(m)
    card = F.rlike(m, F.lit(r"^[2-6]\d*(?:[ -]\d+)*$")) & (F.length(numbers) >= 13)
    card = F.when(card, _luhn_sum(numbers) % 10 == 0).otherwise(F.lit(False))

    def plain(kind, canon):
        return F.array(_unit(gap, kind, canon, m))

    return (
        F.when(F.contains(m, F.lit("@")), email)
        .when(F.rlike(m, F.lit(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")), plain("ip", m))
        .when(F.rlike(m, F.lit(rf"^{_TITLE}\.? \p{{Lu}}")), F.when(F.size(names) > 1, two).otherwise(one))
        .when(F.rlike(m, F.lit(r"^\d{3}-\d{2}-\d{4}$")), plain("ssn", numbers))
        .when(F.rlike(m, F.lit(r"^(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{4})$")), plain(F.when(card, F.lit("card")), numbers))
        .when(F.rlike(m, F.lit(r"^[+(\d][\d ().-]*\d$")), plain("phone", numbers))
        .otherwise(plain("secret", m))
    )


def units(text: Column) -> Column:
    """All units of a text in order, and behind them one unit without kind that leads with the rest of the text."""

    def of_gaps(gaps):
        def of_matches(found):
            each = F.transform(found, lambda m, i: _units_of(F.get(gaps, i), m))
            nothing = F.lit(None).cast("string")
            rest = F.array(_unit(F.element_at(gaps, -1), nothing, nothing, F.lit("")))
            return F.concat(F.flatten(each), rest)

        return bind(F.regexp_extract_all(text, F.lit(ANY), F.lit(0)), of_matches)

    return bind(F.split(text, ANY, -1), of_gaps)


# --- surrogates -------------------------------------------------------------------------------------------------------


def _pick(seed: Column, i: Column, n: int) -> Column:
    return F.pmod(F.xxhash64(seed, i), F.lit(n)).cast("int")


def _letters(seed: Column, i: Column, alphabet: str) -> Column:
    return F.substr(F.lit(alphabet), _pick(seed, i, len(alphabet)) + 1, F.lit(1))


def _scrambled(seed: Column, text: Column, hexadecimal: Column) -> Column:
    """Digits become digits, letters letters of the same case and script, all else stays."""

    def one(c, i):
        return (
            F.when((c >= "0") & (c <= "9"), _pick(seed, i, 10).cast("string"))
            .when((c >= "a") & (c <= "f") & hexadecimal, F.chr(_pick(seed, i, 6) + 97))
            .when((c >= "A") & (c <= "Z"), F.chr(_pick(seed, i, 26) + 65))
            .when(F.rlike(c, F.lit(r"\p{IsCyrillic}")), _letters(seed, i, _CYRILLIC_CONSONANTS + _CYRILLIC_VOWELS))
            .when(F.rlike(c, F.lit(r"\p{L}")), F.chr(_pick(seed, i, 26) + 97))
            .otherwise(c)
        )

    return F.array_join(F.transform(F.split(text, ""), one), "")


def _name(seed: Column, kind: Column, attempt: Column) -> Column:
    """Syllables in the unit's script with an ending of its gender; later attempts are longer."""

    def build(consonants, vowels, endings):
        count = F.lit(3) + F.floor(attempt / 3).cast("int")
        syllables = F.transform(
            F.sequence(F.lit(1), count),
            lambda i: F.concat(_letters(seed, i, consonants), _letters(seed, -i, vowels)),
        )
        male, female, family = endings
        end = F.when(F.startswith(kind, F.lit("given-male")), F.lit(male)).when(
            F.startswith(kind, F.lit("given-female")), F.lit(female)
        ).otherwise(F.lit(family))
        return F.initcap(F.concat(F.array_join(syllables, ""), end))

    cyrillic = build(_CYRILLIC_CONSONANTS, _CYRILLIC_VOWELS, ("н", "на", "ко"))
    return F.when(F.endswith(kind, F.lit("cyrillic")), cyrillic).otherwise(build(_CONSONANTS, _VOWELS, ("n", "na", "son")))


def surrogate(kind: Column, canon: Column, attempt: Column, key: str) -> Column:
    """The draw number ``attempt`` for a unit."""

    def draw(seed):
        no = F.lit(False)
        number = _scrambled(seed, canon, no)
        phone = F.concat(F.substring(canon, 1, 1), F.substr(number, F.lit(2)))
        body = F.concat(F.substring(canon, 1, 1), F.substr(number, F.lit(2), F.length(number) - 2))
        check = F.pmod(-_luhn_sum(F.concat(body, F.lit("0"))), F.lit(10)).cast("string")
        octets = [(_pick(seed, F.lit(1), 223) + 1), *[_pick(seed, F.lit(i), 256) for i in (2, 3, 4)]]
        label = F.regexp_replace(_scrambled(seed, F.substring_index(canon, ".", 1), no), r"[^\p{L}\p{N}]", "x")
        label = F.concat(label, _letters(seed, F.lit(-1), _CONSONANTS), _letters(seed, F.lit(-2), _VOWELS), _pick(seed, F.lit(-3), 1000))
        tld = F.substring_index(canon, ".", -1)
        tld = F.when(tld.isin("com", "net", "org"), tld).otherwise(F.lit("org"))
        longer = F.when(attempt < 3, F.lit("")).otherwise(_pick(seed, F.lit(-4), 1_000_000).cast("string"))
        return (
            F.when(kind == "email", F.concat(_scrambled(seed, F.substring_index(canon, "@", 1), no), longer))
            .when(kind == "domain", F.concat(label, F.lit(".example."), tld))
            .when(kind == "ip", F.concat_ws(".", *[o.cast("string") for o in octets]))
            .when(kind == "card", F.concat(body, check))
            .when(kind == "phone", phone)
            .when(kind == "ssn", number)
            .when(kind == "secret", _scrambled(seed, canon, F.rlike(canon, F.lit("^[0-9a-f]+$"))))
            .otherwise(_name(seed, kind, attempt))
        )

    secret = F.sha2(F.concat_ws("\x1f", F.lit(key), kind, canon, attempt.cast("string")), 256)
    return bind(secret, draw)


def surrogates(entities: DataFrame, key: str, attempts: int = 60) -> DataFrame:
    """(kind, scope, canon, surrogate) for distinct units, no two alike within kind and scope."""
    names = ["kind", "scope"]
    entities = stored(entities.select(*names, "canon").distinct(), "units")
    taken = entities.select(*names, F.col("canon").alias("surrogate"))
    todo, done = entities.withColumn("attempt", F.lit(0)), None
    for number in range(attempts):
        drawn = todo.withColumn("surrogate", surrogate(F.col("kind"), F.col("canon"), F.col("attempt"), key))
        drawn = stored(drawn, "drawn")
        first = drawn.groupBy(*names, "surrogate").agg(F.min("canon").alias("canon"))
        # Mailboxes move to another domain and cannot be taken for a real one. A crowded kind (most IPs there are)
        # may have to use units of the corpus in the end; they are replaced themselves, so none of them is left.
        fine = first.join(taken, [*names, "surrogate"], "left_anti") if number < 8 else first
        if done is not None:
            fine = fine.join(done.select(*names, "surrogate"), [*names, "surrogate"], "left_anti")
        fine = stored(fine.select(*names, "canon", "surrogate"), "surrogates")
        done = fine if done is None else done.unionByName(fine)
        left = drawn.join(fine, [*names, "canon"], "left_anti")
        todo = stored(left.select(*names, "canon", (F.col("attempt") + 1).alias("attempt")), "again")
        if todo.isEmpty():
            return done
    raise RuntimeError("no distinct surrogates found")


def _poured(form: Column, digits: Column) -> Column:
    """``form`` with its digits replaced, in order, by ``digits``."""
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("at"))

    def step(state, c):
        digit = (c >= "0") & (c <= "9")
        new = F.when(digit, F.substr(digits, state.at, F.lit(1))).otherwise(c)
        return F.struct(F.concat(state.out, new).alias("out"), F.when(digit, state.at + 1).otherwise(state.at).alias("at"))

    return F.aggregate(F.split(form, ""), start, step, lambda s: s.out)


def _filled(text: Column, found: Column) -> Column:
    """The text with the units at the places of ``found`` (place -> surrogate) replaced."""

    def one(u, i):
        new = F.try_element_at(found, i)
        shown = F.when(new.isNull(), u.form).when(u.kind.isin(*DIGIT_KINDS), _poured(u.form, new)).otherwise(new)
        return F.concat(u.lead, shown)

    return F.array_join(F.transform(units(text), one), "")


def replaced(df: DataFrame, text: str = "text", key: str = "surrogates", count: str | None = None) -> DataFrame:
    """``df`` with the personal data of ``text`` replaced; ``count`` names a column for the number of units."""
    mark, held = free_name(df, "text_key"), free_name(df, "text_units")
    hint = F.coalesce(F.rlike(col(text), F.lit(HINT)), F.lit(False))
    possible = df.filter(hint).withColumn(mark, F.sha2(col(text), 256))
    found = possible.select(F.col(mark).alias("k"), F.posexplode(units(col(text))).alias("place", "unit"))
    found = found.filter("unit.kind is not null").select("k", "place", "unit.kind", "unit.scope", "unit.canon")
    found = stored(found.distinct(), "found-units")
    known = surrogates(found, key)
    filled = found.join(known, ["kind", "scope", "canon"]).groupBy(F.col("k").alias(f"{mark}_k")).agg(
        F.map_from_entries(F.collect_list(F.struct("place", "surrogate"))).alias(held)
    )
    joined = possible.join(filled, possible[mark] == filled[f"{mark}_k"], "left")
    none = F.col(held).isNull()
    new = F.when(none, col(text)).otherwise(_filled(col(text), F.col(held)))
    zero = F.lit(0).cast("bigint")
    number = [F.when(none, zero).otherwise(F.size(held).cast("bigint")).alias(count)] if count else []
    columns = [col(c) if c != text else new.alias(c) for c in df.columns]
    rest = df.filter(~hint).select(*[col(c) for c in df.columns], *[zero.alias(count) for _ in number])
    return joined.select(*columns, *number).unionByName(rest)
