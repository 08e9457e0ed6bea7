"""PII surrogates: keyed, type-consistent replacements, with DataFrame functions only.

One pattern finds emails, phone numbers, IPv4 addresses, card and account numbers, social security numbers, secrets
(access keys, long hex strings, values after password=, token= and the like) and names: a title with capitalised
words, a known given name with a surname, or capitalised words in a context such as "my name is", "Author:" or
"Regards," before or "wrote" and "said" after. A match splits into entities, each a kind and a canonical form:
separators and case don't count, an email's domain is an entity of its own, and so is each given name and surname.
An entity's surrogate is drawn by SHA-512 of key, kind, canonical form and attempt. It keeps the format: digits,
letters and their case stay in place, country codes, key prefixes and hex alphabets are kept, address parts stay valid,
card numbers stay valid where they were, and names keep gender and script. Equal entities get equal surrogates
everywhere. Coreference: within a text, capitalised words that equal a given name or surname found there in full get
that name's surrogate wherever they stand alone.

Collision check: over all distinct entities, no two of a kind share a surrogate, and none is another entity that
occurs; those that do (all but one of each) draw again with a higher attempt until none does. From the third
attempt on, what a small format can't tell apart grows: emails, domains, values and phone numbers get more characters,
addresses other lengths of their parts, surnames more syllables, given names a second name. An entity still without a
surrogate after MAX_ATTEMPTS is an error, never a silent collision. The few entities
of higher attempts reach the texts as one map while there are at most MAX_MAP, and by a join beyond.

Defined results: null stays null, empty and unmatched texts stay as they are; repeated rows are replaced alike;
overlapping matches are resolved from the left; an empty table gives an empty result; columns named n_entities,
kinds are replaced, whatever their case. Names without title, list, context or a full mention in the text aren't found.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.common import col, others, stored

MAX_MAP = 10_000
MAX_ATTEMPTS = 200

# Titles by gender, given names by script and gender, surnames by script.
TITLES = {
    "m": "Mr Mister Sir Herr Señor Sr Monsieur Don",
    "f": "Mrs Ms Miss Madam Frau Señora Sra Señorita Madame Mme Mademoiselle Mlle Doña",
    "u": "Dr Prof Professor Doctor",
}
GIVEN = {
    ("latin", "m"): "James John Robert Michael William David Richard Joseph Thomas Charles Daniel Matthew Anthony Steven Andrew Joshua Kevin Brian George Edward Carlos Miguel Javier Alejandro Pedro Pierre Jacques Nicolas Antoine Étienne Hans Jürgen Klaus Stefan Matthias Wolfgang",
    ("latin", "f"): "Mary Patricia Jennifer Linda Elizabeth Barbara Susan Jessica Sarah Karen Nancy Margaret Sandra Ashley Emily Michelle Amanda Melissa Deborah Stephanie María Carmen Isabel Lucía Sofía Camille Juliette Amélie Chloé Hélène Ursula Ingrid Katharina Sabine Heike Monika",
    ("cyrillic", "m"): "Иван Дмитрий Сергей Алексей Николай Владимир Михаил Павел Андрей Максим Юрий Олег",
    ("cyrillic", "f"): "Анна Мария Елена Ольга Наталья Татьяна Ирина Светлана Екатерина Юлия Людмила Галина",
    ("greek", "m"): "Γιώργος Δημήτρης Νίκος Κώστας Γιάννης Παναγιώτης Βασίλης Χρήστος",
    ("greek", "f"): "Μαρία Ελένη Κατερίνα Αγγελική Βασιλική Σοφία Δήμητρα Ιωάννα",
}
SURNAMES = {
    "latin": "Adler Barnett Calloway Dalton Ellison Farrell Gallagher Hartwell Ingram Jarvis Kendall Langley Maddox Norwood Oakley Prescott Quinlan Radcliffe Sheridan Thornton Underhill Vance Whitaker Yardley",
    "cyrillic": "Орлов Зайцев Лебедев Козлов Новиков Морозов Волков Соловьёв Васильев Павлов Семёнов Голубев",
    "greek": "Αντωνίου Βασιλείου Γεωργίου Δημητρίου Ιωάννου Κωνσταντίνου Νικολάου Παύλου",
}

# Syllables of surnames of later attempts, by script.
SYLLABLES = {
    "latin": "ba bel bor cal car cor da del dor el fa fen gar gel ha hol ka kel kor la lin lor ma mer mon na nel nor pa per ra ren ro sa sel tal tor va ver win",
    "cyrillic": "ба бе бор ва вел гор да дер ен за зин ка кол ла лен ма мир на нов ор па пет ра рин са сол та тин ша щук",
    "greek": "αν βα γε δη ει ζα ηλ θε ιω κα κο λα μα νι ξε οδ πα ρα σα τα υψ φι χα ωρ",
}

_octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_given = "|".join(n for names in GIVEN.values() for n in names.split())
_titles = "|".join(t for titles in TITLES.values() for t in titles.split())
_word = r"\p{Lu}[\p{L}’']*\p{L}"
_before = r"(?:[Mm]y name is|[Nn]ame:|[Aa]uthor:|[Cc]ontact:|[Ss]igned by|[Ww]ritten by|[Rr]egards,|[Ss]incerely,)\s{1,2}"
_edge = r"(?<=^|[.,;:!?\n(\"“”]\s{0,2})"
_end = r"(?=\s?[.,;:!?\n)\"“”]|\s?$)"
_no_name = r"(?!(?:The|A|An|This|That|These|Those|Our|Your|Their|His|Her|My|Its|No|New|North|South|East|West|Great|United|Saint|San|Los|Las|Very|So|Not|Just|Also|Really|All|Some|Many|Most|Every|Each)\b)"
_hint = r"(?i:password|passwd|pwd|token|secret|api[_\-]?key)[\"']?\s{0,2}[=:]"
_after = r" (?:wrote|writes|said|says|asked|replied|told)(?!\p{L})"
PATTERNS = {
    "value": rf"(?<=[=:]\s{{0,2}}[\"']?)(?<={_hint}\s{{0,2}}[\"']?)[^\s\"',;]{{6,}}+",
    "email": r"(?<![A-Za-z0-9._%+\-])[A-Za-z0-9._%+\-]{1,64}+@[A-Za-z0-9\-]{1,63}(?:\.[A-Za-z0-9\-]{1,63}){1,6}",
    "key": r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![0-9A-Za-z])|(?<![A-Za-z0-9])(?:[0-9a-f]{32,}+|[0-9A-F]{32,}+)(?![0-9A-Za-z])",
    "ip6": r"(?<![\w:])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){1,6}(?::[0-9A-Fa-f]{1,4}){1,6})(?![\w:])",
    "ip": rf"(?<![\d.]){_octet}(?:\.{_octet}){{3}}(?!\d|\.\d)",
    "ssn": r"(?<![\w\-])\d{3}-\d{2}-\d{4}(?![\w\-])",
    "iban": r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)",
    "card": r"(?<![\w.])(?:\d{4}[ \-]\d{4}[ \-]\d{4}[ \-]\d{4}|\d{13,19})(?!\w)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .\-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .\-]?\d{2,4}){1,4}(?!\w)|(?<![\w+])(?:\(\d{3}\) ?|\d{3}[ .\-])\d{3}[ .\-]\d{4}(?!\w)|(?<![\w+.])0\d{2,4}[ \-]\d{3,4}[ \-]\d{3,4}(?!\w)",
    # What begins no name or title in capitals is passed over at once.
    "name": rf"(?=\p{{Lu}})(?<!\p{{L}})(?:(?:{_titles}|{_titles.upper()})\.? {_word}(?:[ \-]{_word}){{0,2}}|(?:{_given}|{_given.upper()})(?: {_word}){{1,2}}|(?<={_before}){_word}(?: {_word}){{1,2}}|(?<=I am |I'm ){_no_name}{_word} {_word}{_end}|{_edge}{_no_name}{_word} {_word}(?:(?= and {_word} {_word}{_after})|(?={_after}))|(?<= and ){_no_name}{_word} {_word}(?={_after}))",
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
# Whatever ANY matches has one of these: a sign of an address, a number, a name, a value's context or a key of letters.
HINT = rf"[@0-9]|\p{{L}}\.? \p{{Lu}}|{_hint}|::|[A-Za-z]{{20}}"


def kind_of(v: Column) -> Column:
    out = None
    for kind, pattern in PATTERNS.items():
        if kind == "value":  # its context isn't part of the match: whatever no other kind takes
            continue
        here = v.rlike(f"^(?:{pattern})$")
        out = F.when(here, kind) if out is None else out.when(here, kind)
    return out.when(v.rlike(f"^{_word}(?: {_word})+$"), "name").otherwise("value")  # by its context; a value has no space


def script_of(token: Column) -> Column:
    return F.when(token.rlike(r"^\p{IsCyrillic}"), "cyrillic").when(token.rlike(r"^\p{IsGreek}"), "greek").otherwise("latin")


def one_of(token: Column, words: str) -> Column:
    return F.lower(token).isin([w.lower() for w in words.split()])


def name_tokens(v: Column) -> Column:
    """Words and separators of a name, in order."""
    return F.regexp_extract_all(v, F.lit(r"[\p{L}’']+\.?|[ \-]"), F.lit(0))


def name_kind(token: Column, i: Column, tokens: Column) -> Column:
    """title, space, given_m, given_f, given_u or surname."""
    title = lambda t: one_of(F.rtrim(t, F.lit(".")), " ".join(TITLES.values()))
    first = F.element_at(tokens, 1)
    bare = F.rtrim(first, F.lit("."))
    told = F.when(one_of(bare, TITLES["m"]), "given_m").when(one_of(bare, TITLES["f"]), "given_f").otherwise("given_u")
    known = F.when(one_of(token, " ".join(GIVEN[k] for k in GIVEN if k[1] == "m")), "given_m").when(one_of(token, " ".join(GIVEN[k] for k in GIVEN if k[1] == "f")), "given_f")
    start = F.when(title(first), 2).otherwise(0)
    return (
        F.when(token.rlike(r"^[ \-]$"), "space")
        .when((i == 0) & title(token), "title")
        .when((i == start) & (F.size(tokens) > start + 1), F.coalesce(known, told))
        .otherwise("surname")
    )


def listed(token: Column) -> Column:
    """The gender that the lists give a name: 1 male, 2 female, 0 neither."""
    of = lambda g: " ".join(GIVEN[k] for k in GIVEN if k[1] == g)
    return F.when(one_of(token, of("m")), 1).when(one_of(token, of("f")), 2).otherwise(0)


def told(v: Column) -> Column:
    """Of a name's match: its given name's entity, and its kind by list or title; null where neither tells a gender."""
    tokens = name_tokens(v)
    each = F.transform(tokens, lambda t, i: F.struct(F.concat(F.lit("given:"), F.lower(t)).alias("entity"), name_kind(t, i, tokens).alias("kind")))
    return F.try_element_at(F.filter(each, lambda x: x["kind"].isin("given_m", "given_f")), F.lit(1))


COUNTRY = r"^\+(\d{1,3}?)(?=[ .\-(]|\d{7})"


def entities(v: Column, kind: Column) -> Column:
    """Keys kind:canonical of a match. A phone number's country code stands before a point."""
    at = F.instr(v, "@")
    email = F.array(F.concat(F.lit("email:"), F.lower(v)), F.concat(F.lit("domain:"), F.lower(F.substring(v, at + 1, F.length(v)))))
    tokens = name_tokens(v)
    names = F.filter(F.transform(tokens, lambda t, i: F.concat(F.regexp_replace(name_kind(t, i, tokens), "_[mfu]$", ""), F.lit(":"), F.lower(t))), lambda k: ~k.rlike("^(?:space|title):"))
    bare = F.regexp_replace(v, "[^0-9A-Za-z]", "")
    country = F.regexp_extract(v, COUNTRY, 1)
    phone = F.when(country != "", F.concat(country, F.lit("."), F.substring(bare, F.length(country) + 1, F.length(bare)))).otherwise(bare)
    plain = F.array(F.concat(kind, F.lit(":"), F.when(kind.isin("key", "value", "ip"), v).when(kind == "ip6", F.lower(v)).when(kind == "phone", phone).otherwise(F.upper(bare))))
    return F.when(kind == "email", email).when(kind == "name", names).otherwise(plain)


def once(value: Column, f) -> Column:
    """f(value), by an array of one, so that the value is worked out once and not at each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def number(seed: Column, i: Column) -> Column:
    """The i-th number (from 0) drawn of a 512-bit hex digest, 0 to 65535; every 32 have a digest of their own."""
    digest = F.when(i < 32, seed).otherwise(F.sha2(F.concat_ws("|", seed, F.floor(i / 32).cast("string")), 512))
    return F.conv(F.substring(digest, F.pmod(i, F.lit(32)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def seed_of(key: str, entity: Column, attempt: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), entity, attempt.cast("string")), 512)


def like(v: Column, seed: Column, keep: Column | int, hexes: Column) -> Column:
    """v with its letters and digits redrawn in place (from A-Z, a-z and 0-9), but for the first `keep`; hexes: only hex letters. Work is in
    proportion to the length: pieces of 64 characters, longer than any kind whose separators don't count."""
    keep = keep if isinstance(keep, Column) else F.lit(keep)

    def whole(x: Column) -> Column:
        def piece(p: Column, k: Column) -> Column:
            place = lambda i: k * 64 + F.length(F.regexp_replace(F.substring(p, F.lit(1), i + 1), r"[^\p{Nd}\p{L}]", "")) - 1

            def drawn(c: Column, i: Column) -> Column:
                letters = F.when(x["hexes"], 6).otherwise(26)
                letter = lambda n: F.char(F.when(c.rlike(r"\p{Lu}"), 65).otherwise(97) + F.pmod(n, letters))
                new = lambda n: F.when(c.rlike(r"\p{Nd}"), F.pmod(n, F.lit(10)).cast("string")).otherwise(letter(n))
                at = lambda i: F.when(i < x["keep"], c).otherwise(once(number(x["seed"], i), new))
                return F.when(~c.rlike(r"[\p{Nd}\p{L}]"), c).otherwise(once(place(i), at))

            return F.array_join(F.transform(F.split(p, ""), drawn), "")

        return F.array_join(F.transform(F.regexp_extract_all(v, F.lit("(?s).{1,64}"), F.lit(0)), piece), "")

    return once(F.struct(seed.alias("seed"), keep.alias("keep"), hexes.alias("hexes")), whole)


def more(seed: Column, attempt: Column, digits: bool = False) -> Column:
    """What a surrogate of a later attempt grows by: a character at the third attempt, two at the sixth, and so on."""
    drawn = F.substring(F.sha2(F.concat(seed, F.lit("|more")), 512), F.lit(1), F.least(F.lit(100), F.floor(attempt / 3)).cast("int"))
    return F.translate(drawn, "abcdef", "012345") if digits else drawn


def luhn(digits: Column, skip_last: bool) -> Column:
    """The checksum of a digit string; skip_last: with a 0 in the last place."""
    places = F.reverse(F.split(digits, ""))
    each = lambda c, i: F.when(F.pmod(i, F.lit(2)) == 1, F.when(c.cast("int") > 4, c.cast("int") * 2 - 9).otherwise(c.cast("int") * 2)).otherwise(F.when(F.lit(skip_last) & (i == 0), 0).otherwise(c.cast("int")))
    return F.aggregate(F.transform(places, each), F.lit(0), lambda s, x: s + x)


def card(v: Column, seed: Column) -> Column:
    out = like(v, seed, F.lit(1), F.lit(False))
    only = lambda x: F.regexp_replace(x, "[^0-9]", "")
    valid = F.pmod(luhn(only(v), False), F.lit(10)) == 0
    check = F.pmod(-luhn(only(out), True), F.lit(10)).cast("string")
    return F.when(valid, F.concat(F.substring(out, F.lit(1), F.length(out) - 1), check)).otherwise(out)


def address(v: Column, seed: Column, attempt: Column) -> Column:
    """Each part redrawn with as many digits as it had; any from 1 to 254 from the third attempt on."""
    least = lambda p: F.when(attempt >= 3, 1).when(F.length(p) == 3, 100).when(F.length(p) == 2, 10).otherwise(1)
    many = lambda p: F.when(attempt >= 3, 254).when(F.length(p) == 3, 155).when(F.length(p) == 2, 90).otherwise(9)
    return F.array_join(F.transform(F.split(v, r"\."), lambda p, i: (least(p) + F.pmod(number(seed, i), many(p))).cast("string")), ".")


def picker(names: Column, seed: Column):
    return lambda i: F.element_at(names, F.pmod(number(seed, i), F.size(names)) + 1)


def name_word(token: Column, kind: Column, seed: Column, attempt: Column, gender: Column) -> Column:
    """A name of the token's kind (given, of a gender, or surname), script and case. Of later attempts, given names join several, surnames are made of syllables."""

    def drawn(x: Column) -> Column:
        lists = {}
        for script in SURNAMES:
            male, female = GIVEN[script, "m"].split(), GIVEN[script, "f"].split()
            for k, names in (("given1", male), ("given2", female), ("given0", male + female), ("surname0", SURNAMES[script].split()), ("syllable", SYLLABLES[script].split())):
                lists[script, k] = F.array(*[F.lit(n) for n in names])
        chosen = None
        for (script, k), names in lists.items():
            chosen = F.when(x["list"] == f"{script}:{k}", names) if chosen is None else chosen.when(x["list"] == f"{script}:{k}", names)
        # Attempts 0 to 2 draw one given name, then two joined, then three and more; a surname has two syllables, then more.
        many = F.when(x["made"], F.least(F.lit(30), 1 + F.floor(x["attempt"] / 2))).otherwise(F.greatest(F.lit(0), F.floor(x["attempt"] / 3))).cast("int")
        joined = once(chosen, lambda names: F.call_function("array_join", F.transform(F.sequence(F.lit(0), many), picker(names, x["seed"])), F.when(x["made"], "").otherwise("-")))
        word = once(joined, lambda w: F.when(x["made"], F.initcap(w)).otherwise(w))
        return F.when((x["token"] == F.upper(x["token"])) & (F.length(x["token"]) > 1), F.upper(word)).otherwise(word)

    made = (kind == "surname") & (attempt >= 2)
    source = F.concat(script_of(token), F.lit(":"), F.when(made, "syllable").otherwise(F.concat(kind, F.when(kind == "given", gender).otherwise(0).cast("string"))))
    return once(F.struct(token.alias("token"), source.alias("list"), made.alias("made"), seed.alias("seed"), attempt.alias("attempt")), drawn)


def described(matches: Column) -> Column:
    """Matches with their kinds and entities."""
    kinds = F.transform(matches, lambda v: F.struct(v.alias("v"), kind_of(v).alias("kind")))
    return F.transform(kinds, lambda x: F.struct(x["v"].alias("v"), x["kind"].alias("kind"), entities(x["v"], x["kind"]).alias("keys")))


def drawn_for(entity: Column, key: str, code_of, f) -> Column:
    """f(seed, attempt, gender) of an entity, all worked out once. code_of: its attempt times three, plus its gender."""
    seeded = lambda x: F.struct(seed_of(key, x["e"], F.floor(x["n"] / 3)).alias("seed"), F.floor(x["n"] / 3).cast("int").alias("attempt"), F.pmod(x["n"], F.lit(3)).alias("gender"))
    both = once(F.struct(entity.alias("e"), code_of(entity).alias("n")), seeded)
    return once(both, lambda x: f(x["seed"], x["attempt"], x["gender"]))


def surrogate(match: Column, key: str, code_of) -> Column:
    """The replacement of a described match. code_of: see drawn_for."""
    v, kind, keys = match["v"], match["kind"], match["keys"]
    at = F.instr(v, "@")
    first, second = F.element_at(keys, 1), F.element_at(keys, 2)
    local, domain = F.substring(v, F.lit(1), at - 1), F.substring(v, at + 1, F.length(v))
    top = F.regexp_extract(domain, r"([^.]*)$", 1)
    bare = F.substring(domain, F.lit(1), F.length(domain) - F.length(top) - 1)
    none, no = F.lit(0), F.lit(False)
    new_domain = drawn_for(second, key, code_of, lambda seed, n, _: F.concat(like(bare, seed, none, no), more(seed, n), F.lit("."), top))
    email = F.concat(drawn_for(first, key, code_of, lambda seed, n, _: F.concat(like(local, seed, none, no), more(seed, n))), F.lit("@"), new_domain)
    tokens = name_tokens(v)

    def named(t: Column, i: Column) -> Column:
        new = lambda k: drawn_for(F.concat(k, F.lit(":"), F.lower(t)), key, code_of, lambda seed, n, g: name_word(t, k, seed, n, g))
        return once(F.regexp_replace(name_kind(t, i, tokens), "_[mfu]$", ""), lambda k: F.when(k.isin("space", "title"), t).otherwise(new(k)))

    country = F.when(v.startswith("+"), F.length(F.regexp_extract(v, COUNTRY, 1))).otherwise(0)
    kept = F.when(kind == "phone", country).when(v.rlike("^AKIA[0-9A-Z]{16}$"), 4).when(kind == "iban", 2).otherwise(0)
    hexes = (kind == "ip6") | (kind.isin("key", "value") & v.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))

    def plain(seed: Column, n: Column, _: Column) -> Column:
        grown = F.when(kind == "value", more(seed, n)).when(kind == "phone", more(seed, n, True)).otherwise("")
        return F.when(kind == "ip", address(v, seed, n)).when(kind == "card", card(v, seed)).otherwise(F.concat(like(v, seed, kept, hexes), grown))

    names = F.array_join(F.transform(tokens, named), "")
    return F.when(kind == "email", email).when(kind == "name", names).otherwise(drawn_for(first, key, code_of, plain))


def canonical_surrogate(entity: Column, key: str, attempt: Column, gender: Column) -> Column:
    """What an entity becomes, in canonical form, to compare with other entities."""
    kind, value = F.regexp_extract(entity, "^([a-z_0-9]+):", 1), F.regexp_replace(entity, "^[a-z_0-9]+:", "")

    def made(x: Column) -> Column:
        kind, value, seed, n = (x[c] for c in ("kind", "value", "seed", "attempt"))
        at, none, no = F.instr(value, "@"), F.lit(0), F.lit(False)
        domain = F.concat(like(F.regexp_replace(value, r"\.[^.]*$", ""), seed, none, no), more(seed, n), F.lit("."), F.regexp_extract(value, r"([^.]*)$", 1))
        # An email's local part alone has to differ within its domain.
        email = F.concat(like(F.substring(value, F.lit(1), at - 1), seed, none, no), more(seed, n), F.substring(value, at, F.length(value)))
        hexes = (kind == "ip6") | (kind.isin("key", "value") & value.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"))
        kept = F.when(value.rlike("^AKIA[0-9A-Z]{16}$"), 4).when(kind == "iban", 2).when(kind == "phone", F.length(F.regexp_extract(value, r"^(\d*)\.", 1))).otherwise(0)
        grown = F.when(kind == "value", more(seed, n)).when(kind == "phone", more(seed, n, True)).otherwise("")
        new = (
            F.when(kind == "email", email)
            .when(kind == "domain", domain)
            .when(kind.isin("given", "surname"), F.lower(name_word(value, kind, seed, n, x["gender"])))
            .when(kind == "ip", address(value, seed, n))
            .when(kind == "card", card(value, seed))
            .otherwise(F.concat(like(value, seed, kept, hexes), grown))
        )
        return F.concat(kind, F.lit(":"), new)  # genders share one space of given names

    return once(F.struct(kind.alias("kind"), value.alias("value"), seed_of(key, entity, attempt).alias("seed"), attempt.alias("attempt"), gender.alias("gender")), made)


def resolved(found: DataFrame, key: str) -> DataFrame:
    """(entity, code) of the distinct entities (entity, gender) whose code isn't the lists' gender alone: those whose first
    surrogate collides, and given names on no list whose gender titles tell."""
    found = stored(found, "entities")
    taken = found.select(F.col("entity").alias("new")).distinct()
    settled = found.select("entity", "gender", F.lit(0).alias("attempt"))
    for _ in range(MAX_ATTEMPTS):
        drawn = settled.withColumn("new", canonical_surrogate(F.col("entity"), key, F.col("attempt"), F.col("gender")))
        # The entity of fewest attempts, then the smallest, keeps a shared surrogate.
        first = drawn.groupBy("new").agg(F.min(F.struct(-F.col("attempt"), F.col("entity"))).alias("first"), F.count("*").alias("n"))
        bad = first.where("n > 1").join(drawn, "new").where(F.struct(-F.col("attempt"), F.col("entity")) != F.col("first")).select("entity")
        known = drawn.join(taken, "new", "left_semi").select("entity")
        again = stored(bad.union(known).distinct(), "again")
        if again.isEmpty():
            plain = F.when(F.col("entity").startswith("given:"), listed(F.substring("entity", 7, 1_000_000))).otherwise(0)
            return settled.select("entity", (F.col("attempt") * 3 + F.col("gender")).alias("code")).where(F.col("code") != plain)
        settled = stored(settled.join(again.withColumn("more", F.lit(1)), "entity", "left").select("entity", "gender", (F.col("attempt") + F.coalesce("more", F.lit(0))).alias("attempt")), "attempts")
    kinds = sorted(r[0] for r in again.select(F.regexp_extract("entity", "^([a-z_0-9]+):", 1)).distinct().collect())
    raise ValueError(f"no free surrogates are left for entities of these kinds: {', '.join(kinds)}")


def entity_table(docs: DataFrame, text: str) -> DataFrame:
    """(entity, gender) of all entities of the texts. A given name's gender is the lists', else what most of the different
    matches with a title tell; of as many on both sides, or none, neither."""
    found = docs.select(F.explode(matches_of(col(text))).alias("v")).distinct().select("v", kind_of(F.col("v")).alias("kind"))
    told_by = F.when(F.col("kind") == "name", told(F.col("v")))
    each = found.select(F.explode(entities(F.col("v"), F.col("kind"))).alias("entity"), told_by.alias("told"))
    votes = F.when(F.col("told.entity") == F.col("entity"), F.when(F.col("told.kind") == "given_m", 1).otherwise(-1)).otherwise(0)
    whole = each.groupBy("entity").agg(F.sum(votes).alias("votes"))
    known = F.when(F.col("entity").startswith("given:"), listed(F.substring("entity", 7, 1_000_000))).otherwise(0)
    gender = F.when(~F.col("entity").startswith("given:"), 0).when(known > 0, known).when(F.col("votes") > 0, 1).when(F.col("votes") < 0, 2).otherwise(0)
    return whole.select("entity", gender.alias("gender"))


def matches_of(text: Column) -> Column:
    hint = F.coalesce(text.rlike(HINT), F.lit(False))
    return F.when(hint, F.regexp_extract_all(text, F.lit(ANY), F.lit(0))).otherwise(F.array().cast("array<string>"))


def lone(matches: Column) -> Column:
    """A map from the given names and surnames of a text's described matches, lower-cased, to their entities."""
    words = lambda x: F.transform(name_tokens(x["v"]), lambda t: F.lower(t))
    of = lambda x: F.filter(F.transform(words(x), lambda t: F.struct(t.alias("word"), F.try_element_at(F.filter(x["keys"], lambda k: F.endswith(k, F.concat(F.lit(":"), t))), F.lit(1)).alias("key"))), lambda e: F.length(e["word"]) > 2)
    found = F.filter(matches, lambda x: x["kind"] == "name")
    pairs = F.flatten(F.transform(found, lambda x: of(x)))
    # A word's first key in order; by sorting, so that a text of many names takes time in proportion.
    ordered = F.array_sort(F.array_distinct(F.filter(pairs, lambda e: e["key"].isNotNull())))
    first = lambda all_: F.filter(all_, lambda e, i: (i == 0) | (e["word"] != F.coalesce(F.get(all_, i - 1)["word"], F.lit(""))))
    return F.map_from_entries(once(ordered, first))


def mentions(part: Column, names: Column, key: str, code_of) -> Column:
    """A stretch of text between matches with lone names replaced."""
    pattern = F.concat(F.lit(r"(?<!\p{L})(?=\p{Lu})(?iu:"), F.array_join(F.map_keys(names), "|"), F.lit(r")(?!\p{L})"))
    new = lambda w: once(F.element_at(names, F.lower(w)), lambda e: drawn_for(e, key, code_of, lambda seed, n, g: name_word(w, F.regexp_extract(e, "^([a-z_0-9]+):", 1), seed, n, g)))
    found = F.regexp_extract_all(part, pattern, F.lit(0))
    return F.array_join(F.zip_with(F.split(part, pattern, F.lit(-1)), F.transform(found, new), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")


def replace(docs: DataFrame, *, key: str = "plumbline", text: str = "text", keep: list[str] | None = None, max_map: int = MAX_MAP) -> DataFrame:
    """docs' columns `keep` (default: all), the text replaced, with n_entities and kinds (of its matches, in order)."""
    keep = others(docs.columns if keep is None else keep, [text, "n_entities", "kinds"])
    order = [c for c in docs.columns if c in keep or c == text] if set(keep) <= set(docs.columns) else [*keep, text]
    higher = stored(resolved(entity_table(docs, text), key), "higher")
    source = docs.select(*[col(c).alias(f"k_{i}") for i, c in enumerate(keep)], col(text).alias("t")).withColumn("m", described(matches_of(F.col("t"))))
    if higher.limit(max_map + 1).count() <= max_map:
        attempts = higher.agg(F.map_from_entries(F.collect_list(F.struct("entity", "code"))).alias("a")).scalar()
        with_map = source.withColumn("a", F.when(F.size("m") > 0, attempts))
    else:
        # By the text's digest: copies share a row, and texts without a match aren't shuffled.
        hit = source.where(F.size("m") > 0).withColumn("digest", F.sha2("t", 256))
        held = hit.select("digest", "m").dropDuplicates(["digest"]).select("digest", F.explode("m").alias("x")).select("digest", F.explode("x.keys").alias("entity")).distinct()
        maps = stored(held.join(higher, "entity").groupBy("digest").agg(F.map_from_entries(F.collect_list(F.struct("entity", "code"))).alias("a")), "maps")
        empty = F.create_map().cast("map<string,int>")
        with_map = hit.join(maps, "digest", "left").drop("digest").unionByName(source.where(~(F.size("m") > 0)).withColumn("a", empty))
    by_list = lambda e: F.when(F.startswith(e, F.lit("given:")), listed(F.substring(e, F.lit(7), F.length(e)))).otherwise(0)
    code_of = lambda e: F.coalesce(F.try_element_at(F.col("a"), e), by_list(e))
    parts = F.transform(F.split("t", ANY, -1), lambda p: F.when(F.size("names") > 0, mentions(p, F.col("names"), key, code_of)).otherwise(p))
    new = F.array_join(F.zip_with(parts, F.transform("m", lambda x: surrogate(x, key, code_of)), lambda p, s: F.concat(p, F.coalesce(s, F.lit("")))), "")
    out = with_map.withColumn("names", lone(F.col("m"))).withColumn("new", F.when(F.size("m") > 0, new).otherwise(F.col("t")))
    named = {c: F.col(f"k_{i}").alias(c) for i, c in enumerate(keep)} | {text: F.col("new").alias(text)}
    return out.select(*[named[c] for c in order], F.size("m").alias("n_entities"), F.col("m.kind").alias("kinds"))
