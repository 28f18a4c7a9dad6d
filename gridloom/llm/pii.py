"""PII: keyed surrogates that keep type, gender, script and format of what they replace.

One pattern finds the entities of a text. An entity's canonical form (digits of a
number, lower case of the rest) and a secret key give a stream of hash digits, from
which a replacement of the same shape is written; so one entity has one surrogate in
all texts, in whatever format it is mentioned. Surrogates of all distinct entities
are compared: where two agree, or one equals an entity that occurs, all but the first
draw again. Everything is built from DataFrame functions.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gridloom.llm.common import checkpointed, free_name

#: Given names by script and gender; a name is detected by one of them before a surname, or by a title.
GIVEN = {
    ("latin", "f"): "Alice Amelia Andrea Angela Anna Barbara Camille Carmen Carolina Charlotte Christine Claire Claudia Elena Elizabeth Emily Emma Eva Hannah Helen Ines Isabel Jennifer Jessica Julia Karen Katharina Laura Linda Lucia Margaret Maria Marie Marta Mary Monika Olivia Patricia Petra Rosa Sabine Sarah Sofia Sophie Susan Ursula",
    ("latin", "m"): "Alejandro Andreas Antoine Antonio Benjamin Carlos Charles Christian Daniel David Diego Felix Fernando Frank Friedrich George Hans Henry Jacques James Javier Jean John Jorge Joseph Juan Klaus Louis Lukas Manuel Markus Martin Michael Miguel Nicolas Oliver Pablo Paul Pedro Peter Philippe Pierre Robert Stefan Thomas William",
    ("cyrillic", "f"): "Александра Анна Валентина Екатерина Елена Ирина Мария Наталья Ольга Светлана Татьяна Юлия",
    ("cyrillic", "m"): "Александр Алексей Андрей Борис Виктор Владимир Дмитрий Иван Михаил Николай Павел Сергей",
    ("greek", "f"): "Αγγελική Αικατερίνη Ελένη Ιωάννα Μαρία Σοφία",
    ("greek", "m"): "Γεώργιος Δημήτριος Ιωάννης Κωνσταντίνος Νικόλαος Παναγιώτης",
}
#: Titles by gender; n tells nothing about it.
TITLES = {"f": ("Mrs.", "Ms.", "Miss", "Mrs", "Ms", "Frau", "Mme", "Mlle", "Señora", "Sra."), "m": ("Mr.", "Mr", "Herr", "Señor", "Sr."), "n": ("Dr.", "Prof.")}

#: Syllables and endings of surrogate names: starts, middles, ends of f, m and n.
SYLLABLES = {
    "latin": ("Ba Be Bo Da De Do Fa Fe Ga Go Ha He Ja Jo Ka Ke La Le Lo Ma Me Mo Na Ne No Pa Pe Ra Re Ro Sa Se So Ta Te To Va Ve Vi Za", "bel dal din dor fan gar len lin lor man mar mel min nal nar nel ral ran rel rin sal san sel sin tal tan tel tin val var vel vin", "a ia ina elle ette ana", "o us in ard ian en", "er mann son ley ard etti"),
    "cyrillic": ("Ба Бе Бо Ва Ве Га Го Да До За Ка Ко Ла Ле Ма Ме На Не Па Пе Ра Ро Са Се Та То", "бел дан дор лан лен лин мар мел мин нар нел рал ран рин сан сел тал тан тел вин", "а ия ина ана", "ей ан ий ор", "ов ин ский енко"),
    "greek": ("Βα Βε Γα Δα Δε Θα Κα Κε Λα Λε Μα Με Να Νε Πα Πε Ρα Σα Σε Τα", "βελ δαν δορ λαν λεν λιν μαρ μελ μιν ναρ νελ ραλ ραν ριν σαν σελ ταλ ταν τελ", "α ία ίνα", "ος ης ας", "ίδης άκης όπουλος"),
}
LETTERS = {"latin": "abcdefghijklmnopqrstuvwxyz", "cyrillic": "абвгдежзийклмнопрстуфхцчшщэюя", "greek": "αβγδεζηθικλμνξοπρστυφχψω"}
#: Letters of scripts without case: first and last code point of the script's part, then first, step and number of those drawn.
RANGES = ((0x4E00, 0x9FFF, 0x4E00, 73, 200), (0xAC00, 0xD7A3, 0xAC00, 53, 200), (0x3040, 0x309F, 0x3042, 1, 80), (0x30A0, 0x30FF, 0x30A2, 1, 80), (0x5D0, 0x5EA, 0x5D0, 1, 27), (0x620, 0x6D3, 0x628, 1, 19), (0x904, 0x939, 0x915, 1, 35), (0xE01, 0xE30, 0xE01, 1, 46))

_SURNAME = r"\p{Lu}(?:[\p{L}\-]|['’](?!s(?!\p{L})))+"
#: Capitalised or in capitals: a capital must come first, and the rest is compared without case.
_NAMES = f"(?iu:{'|'.join(' '.join(GIVEN.values()).split())})"
#: Names in scripts without capitals stand after a title.
_UNCASED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]{2,6}"
_TITLE = "|".join(t.replace(".", r"\.") for g in TITLES.values() for t in g)
_BEFORE = r"(?<![\p{L}\p{N}])"
_AFTER = r"(?![\p{L}\p{N}])"
#: Words after which two or three capitalised words are a person's name.
CUES = "attn author contact dear manager named nombre patient regards reviewer signed sincerely subscriber"
_CUE = rf"(?<=(?<![\p{{L}}\p{{N}}])(?i:{'|'.join(CUES.split())})[:,]? )"
_PERSON = r"\p{Lu}\p{Ll}+(?:[ \-]\p{Lu}\p{Ll}+){1,2}"
_KEYWORD = r"""(?i:pass(?:word|wd)|pwd|secret|token|api[_\- ]?key)["']?[ \t]{0,3}[=:][ \t]{0,3}["']?"""

#: Type, pattern of a mention in a text, pattern of the mention alone (where it differs). The order is that of precedence.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+\-])[\p{L}\p{N}][\p{L}\p{N}._%+\-]*+@[\p{L}\p{N}\-]+(?:\.[\p{L}\p{N}\-]+)+",
    "aws": _BEFORE + r"(?:AKIA|ASIA)[0-9A-Z]{12,}(?![\p{L}\p{N}])",
    "secret": rf"""(?<=[=:"' \t])(?<={_KEYWORD})[^\s"'`<>|]{{5,}}[^\s"'`<>|.,;:!?)\]}}]|""" + _BEFORE + r"(?:[0-9A-Fa-f]{32,}|sk-[A-Za-z0-9]{16,})(?![\p{L}\p{N}])",
    "iban": _BEFORE + r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
    "ip6": r"(?<![\p{L}\p{N}:.])(?=[0-9A-Fa-f:]{0,38}[0-9])(?:(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}|(?:[0-9A-Fa-f]{1,4}:){2,6}(?::[0-9A-Fa-f]{1,4}){1,5})(?![\p{L}\p{N}:])",
    "ip": r"(?<![\p{L}\p{N}.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?![\p{L}\p{N}]|\.\d)",
    "ssn": _BEFORE + r"\d{3}-\d{2}-\d{4}(?![\p{L}\p{N}\-])",
    "phone": r"(?<![\p{L}\p{N}+])(?:\+\d{1,3}[ .\-]?\(?\d{1,4}\)?(?:[ .\-]?\d{2,4}){2,5}|0\d{2,4}[ /\-]\d{5,8}|\(\d{3}\) ?\d{3}[ .\-]\d{4}|\d{3}[.\-]\d{3}[.\-]\d{4})(?![\p{L}\p{N}])",
    "card": _BEFORE + r"\d(?:[ \-]?\d){12,18}(?![\p{L}\p{N}])",
    "name": r"(?=\p{Lu})" + _BEFORE + rf"(?:(?:{_TITLE}) (?:{_NAMES} )?{_SURNAME}|{_NAMES} {_SURNAME})|(?:{_TITLE}) ?{_UNCASED}|(?<= ){_CUE}{_PERSON}" + _AFTER,
}
ENTITY = "|".join(PATTERNS.values())
#: A text without a match of this has no entity.
HINT = rf"[0-9@]|(?<=[:, ]){_CUE}\p{{Lu}}|sk-|AKIA|ASIA|[A-Fa-f]{{32}}|{_KEYWORD}|(?=\p{{Lu}}){_BEFORE}(?:{_TITLE}|{_NAMES}) \p{{Lu}}|(?:{_TITLE}) ?{_UNCASED}"

NUMBERS = ("phone", "card", "ssn")
MAX_DRAWS = 64


def kind_of(mention: Column) -> Column:
    """The type of a mention that ENTITY found."""
    tests = {
        "email": mention.contains("@"),
        "secret": mention.rlike(r"^[0-9A-Fa-f]{32,}$"),
        "aws": mention.rlike(r"^(?:AKIA|ASIA)[0-9A-Z]{12,}$"),
        "ip6": mention.rlike(r"^[0-9A-Fa-f]{0,4}(?::[0-9A-Fa-f]{0,4}){2,7}$"),
        "ip": mention.rlike(r"^\d{1,3}(?:\.\d{1,3}){3}$"),
        "ssn": mention.rlike(r"^\d{3}-\d{2}-\d{4}$"),
        "phone": mention.rlike(r"^(?:\+|\(\d{3}\)|\d{3}[.\-]\d{3}[.\-]\d{4}$|0\d{2,4}[ /\-]\d{5,8}$)"),
        "iban": mention.rlike(r"^[A-Z]{2}\d{2}(?: ?[A-Z0-9]{1,4}){3,8}$"),
        "card": mention.rlike(r"^\d(?:[ \-]?\d){12,18}$"),
        "name": mention.rlike(rf"^\p{{Lu}}[\p{{L}}.'’\-]* \p{{Lu}}|^(?:{_TITLE}) ?{_UNCASED}$"),
    }
    return reduce(lambda rest, x: F.when(x[1], x[0]).otherwise(rest), reversed(tests.items()), F.lit("secret"))


def _words(text: str) -> Column:
    return F.split(F.lit(text), " ")


def _pick(options: Column, number: Column) -> Column:
    return F.get(options, (number % F.size(options)).cast("int"))


def _script(text: Column) -> Column:
    return F.when(text.rlike(r"\p{IsCyrillic}"), "cyrillic").when(text.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _stream(key: Column, kind: Column, canonical: Column, draw: Column) -> Column:
    """256 hash digits that hang on the key, the type, the entity and the number of the draw."""
    seed = F.concat_ws("\x1f", key, kind, canonical, draw.cast("string"))
    return F.concat(*[F.sha2(F.concat_ws("\x1f", seed, F.lit(str(i))), 256) for i in range(4)])


def _byte(stream: Column, i: Column) -> Column:
    return F.conv(F.substring(stream, (F.pmod(i, F.lit(128)) * 2 + 1).cast("int"), F.lit(2)), 16, 10).cast("int")


def canonical_of(kind: Column, mention: Column) -> Column:
    """One form for all spellings of an entity; a number of ten digits is the same with and without +1 before it."""
    national = F.regexp_replace(F.regexp_replace(mention, r"[^0-9]", ""), r"^1(?=[0-9]{10}$)", "")
    return F.when(kind == "phone", national).when(kind.isin(*NUMBERS), F.regexp_replace(mention, r"[^0-9]", "")).when(kind == "iban", F.replace(mention, F.lit(" "), F.lit(""))).when(kind.isin("secret", "aws"), mention).otherwise(F.lower(mention))


def _letters(char: Column) -> Column:
    """The letters of a character's script; Latin ones for scripts without any here."""
    point = F.ascii(char)
    found = F.when(point < 0x250, LETTERS["latin"]).when(char.rlike(r"\p{IsCyrillic}"), LETTERS["cyrillic"]).when(char.rlike(r"\p{IsGreek}"), LETTERS["greek"])
    for first, last, start, step, n in RANGES:
        found = found.when((point >= first) & (point <= last), "".join(chr(start + step * i) for i in range(n)))
    return found.otherwise(LETTERS["latin"])


def _one_of(letters: Column, byte: Column) -> Column:
    return F.substring(letters, byte % F.length(letters) + 1, F.lit(1))


def _anew(body: Column, way: Column, kept: Column, stream: Column) -> Column:
    """body with other characters of the same sort.

    digits: a new one for each, but for the first `kept`; the one after these is 2 to
    9. base32: a capital or 2 to 7 for each. hex: other hexadecimal digits in the case
    of body; where it has both, in that of each letter; what is none stays. letters: a
    letter of the same script and case for a letter, a digit for a digit; others stay.
    """
    upper = body.rlike("^[0-9A-F:]*[A-F][0-9A-F:]*$")
    chars = F.transform(F.split(body, ""), lambda c, i: F.struct(c.alias("c"), i.alias("i"), _byte(stream, i).alias("byte"), F.when(way == "letters", _letters(c)).alias("letters")))

    def draw(x: Column) -> Column:
        c, byte = x["c"], x["byte"]
        digit = F.when(x["i"] < kept, c).otherwise(F.when(x["i"] == kept, byte % 8 + 2).otherwise(byte % 10).cast("string"))
        hexadecimal = F.when(~c.rlike("^[0-9A-Fa-f]$"), c).otherwise(_one_of(F.when(upper | c.rlike("^[A-F]$"), "0123456789ABCDEF").otherwise("0123456789abcdef"), byte))
        letter = F.when(c.rlike("^[0-9]$"), (byte % 10).cast("string")).when(c.rlike(r"^\p{Lu}$"), F.upper(_one_of(x["letters"], byte))).when(c.rlike(r"^\p{L}$"), _one_of(x["letters"], byte)).otherwise(c)
        return F.when(way == "letters", letter).when(way == "digits", digit).when(way == "hex", hexadecimal).otherwise(_one_of(F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"), byte))

    return F.array_join(F.transform(chars, draw), "")


def _into(mention: Column, new: Column, letters: Column) -> Column:
    """mention with its digits, with `letters` also its capitals, replaced by the characters of another string, in order."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("n"))

    def step(s: Column, c: Column) -> Column:
        held = F.when(letters, c.rlike("^[0-9A-Z]$")).otherwise(c.rlike("^[0-9]$"))
        return F.struct(F.concat(s["out"], F.when(held, F.substring(new, s["n"] + 1, F.lit(1))).otherwise(c)).alias("out"), (s["n"] + held.cast("int")).alias("n"))

    return F.aggregate(F.split(mention, ""), start, step)["out"]


def _luhn(digits: Column) -> Column:
    """The digits with the last one replaced by the check digit of the others."""
    body = F.substring(digits, F.lit(1), F.length(digits) - 1)

    def worth(c: Column, i: Column) -> Column:
        twice = c.cast("int") * 2
        return F.when(i % 2 == 0, F.when(twice > 9, twice - 9).otherwise(twice)).otherwise(c.cast("int"))

    total = F.aggregate(F.transform(F.split(F.reverse(body), ""), worth), F.lit(0), lambda a, x: a + x)
    return F.concat(body, ((10 - total % 10) % 10).cast("string"))


def _before_last(mention: Column, canonical: Column) -> Column:
    """The digits of a phone number before its canonical form."""
    digits = F.regexp_replace(mention, r"[^0-9]", "")
    return F.substring(digits, F.lit(1), F.length(digits) - F.length(canonical))


def _email(mention: Column, new: Column, stream: Column, draw: Column) -> Column:
    """new for what stands before the last dot; every fourth draw adds a letter to the local part, so addresses don't run out."""
    extra = F.when(draw >= 4, F.array_join(F.transform(F.sequence(F.lit(1), (draw / 4).cast("int")), lambda i: _one_of(F.lit(LETTERS["latin"]), _byte(stream, 127 - i))), "")).otherwise("")
    return F.concat(extra, new, F.regexp_extract(mention, r"(\.[^.]+)$", 1))


def _iban(canonical: Column, account: Column) -> Column:
    """The country stays, the account is new, and the two digits between them check it (ISO 7064, modulo 97)."""
    country = F.substring(canonical, 1, 2)

    def step(a: Column, c: Column) -> Column:
        return (F.when(c.rlike("^[0-9]$"), a * 10 + F.ascii(c) - 48).otherwise(a * 100 + F.ascii(c) - 55) % 97).cast("int")

    rest = F.aggregate(F.split(F.concat(account, country, F.lit("00")), ""), F.lit(0), step)
    return F.concat(country, F.lpad((98 - rest).cast("string"), 2, "0"), account)


def _address(stream: Column) -> Column:
    return F.concat_ws(".", *[(_byte(stream, F.lit(i)) % 254 + 1).cast("string") for i in range(4)])


def _syllables(script: Column, part: Column) -> Column:
    """Starts, middles and ends of names of a script; part is f, m or n (surname)."""
    out = F.lit(None)
    for name, (starts, middles, *ends) in SYLLABLES.items():
        end = reduce(lambda rest, x: F.when(part == x[0], _words(x[1])).otherwise(rest), zip("fm", ends[:2]), _words(ends[2]))
        out = F.when(script == name, F.array(_words(starts), _words(middles), end)).otherwise(out)
    return out


def _name(syllables: Column, stream: Column, draw: Column) -> Column:
    """A made-up name. Every third draw adds a syllable, so names don't run out."""
    inner = F.sequence(F.lit(1), (F.lit(2) + draw / 3).cast("int"))
    body = F.array_join(F.transform(inner, lambda i: _pick(syllables[1], _byte(stream, i + 9))), "")
    return F.concat(_pick(syllables[0], _byte(stream, F.lit(0))), body, _pick(syllables[2], _byte(stream, F.lit(9))))


def _given_part(word: Column) -> Column:
    """f or m for a known given name; n for any other."""
    women, men = (sorted({w for (_, g), names in GIVEN.items() if g == gender for w in names.split()}) for gender in "fm")
    plain = F.when(word.rlike(r"^\p{Lu}{2,}$"), F.initcap(F.lower(word))).otherwise(word)
    return F.when(plain.isin(*women), "f").when(plain.isin(*men), "m").otherwise("n")


def atoms(mentions: Column, known: Column) -> Column:
    """array<array<struct<word, kind, canonical>>>: what is keyed in each mention; of a name, each word.

    known holds the surnames that may stand alone; see find().

    Each step is an array of its own, so that later ones refer to its values and
    don't repeat its expressions.
    """
    titles = [t for g in TITLES.values() for t in g]

    def of_word(w: Column) -> Column:
        return F.struct(w.alias("word"), F.when(w.isin(*titles), "title").otherwise(F.concat(F.lit("name-"), _given_part(w))).alias("kind"), F.lower(w).alias("canonical"))

    def of_mention(x: Column) -> Column:
        plain = F.array(F.struct(x["m"].alias("word"), x["kind"].alias("kind"), canonical_of(x["kind"], x["m"]).alias("canonical")))
        return F.when(x["kind"] == "name", F.transform(F.split(x["m"], " "), of_word)).otherwise(plain)

    own = F.concat(known, F.transform(known, F.upper))

    return F.transform(F.transform(mentions, lambda m: F.struct(m.alias("m"), F.when(m.rlike(rf"^{_SURNAME}$") & F.array_contains(own, m), "name").otherwise(kind_of(m)).alias("kind"))), of_mention)


def surrogates(words: Column, draw_of, key: str) -> Column:
    """The surrogates of an array of atoms; draw_of(kind, canonical) tells which draw an atom uses.

    As in atoms(), each step is an array of its own: an expression that is used in
    several places would be copied to each, and the driver holds and rewrites them all.
    """
    steps = (
        {"draw": lambda a: draw_of(a["kind"], a["canonical"])},
        {"stream": lambda a: _stream(F.lit(key), a["kind"], a["canonical"], a["draw"]), "named": lambda a: a["kind"].startswith("name-") & ~a["word"].rlike(rf"^{_UNCASED}$")},  # uncased names are reshaped as secrets are
        {"way": lambda a: _way(a["kind"], a["word"], a["named"]), "body": lambda a: _body(a["kind"], a["word"], a["canonical"])},
        {"new": lambda a: F.when(a["way"].isNotNull(), _anew(a["body"], a["way"], _kept(a["kind"], a["canonical"]), a["stream"])), "syllables": lambda a: F.when(a["named"], _syllables(_script(a["word"]), F.substring(a["kind"], F.lit(6), F.lit(1))))},
        {"new": lambda a: F.when(a["named"], _name(a["syllables"], a["stream"], a["draw"])).otherwise(_whole(a["kind"], a["word"], a["canonical"], a["new"]))},
    )
    for step in steps:
        words = F.transform(words, lambda a: reduce(lambda x, f: x.withField(f[0], f[1](a)), step.items(), a))  # noqa: B023
    return F.transform(words, lambda a: written(a["kind"], a["word"], a["draw"], a["stream"], a["new"]))


def _way(kind: Column, mention: Column, named: Column) -> Column:
    """How _anew() writes an atom; null where it doesn't."""
    own = F.when(kind.isin(*NUMBERS), "digits").when(kind == "aws", "base32").when((kind == "ip6") | ~kind.isin("email", "iban") & mention.rlike(r"^[0-9A-Fa-f]+$"), "hex").otherwise("letters")
    return F.when(~named & ~kind.isin("title", "ip"), own)


def _body(kind: Column, mention: Column, canonical: Column) -> Column:
    """The part of an atom that _anew() writes."""
    rest = lambda text, start: F.substring(text, F.lit(start), F.length(text))
    special = F.when(kind == "email", F.regexp_extract(mention, r"^(.*)(\.[^.]+)$", 1)).when(kind.isin(*NUMBERS), canonical).when(kind == "iban", rest(canonical, 5)).when(kind == "aws", rest(mention, 5))
    return special.when(mention.startswith("sk-"), rest(mention, 4)).otherwise(mention)


def _kept(kind: Column, canonical: Column) -> Column:
    """Digits that stay: of a phone number those before the last ten, of a card the first."""
    return F.when(kind == "phone", F.greatest(F.length(canonical) - 10, F.lit(0))).when(kind == "card", 1).otherwise(0)


def _whole(kind: Column, mention: Column, canonical: Column, new: Column) -> Column:
    """new with what belongs before it and with its check digits."""
    return F.when(kind == "phone", F.concat(_before_last(mention, canonical), new)).when(kind == "card", _luhn(new)).when(kind == "iban", _iban(canonical, new)).otherwise(new)


def written(kind: Column, mention: Column, draw: Column, stream: Column, new: Column) -> Column:
    """The surrogate of one atom in the format of its mention; titles stay."""
    named = F.when(mention.rlike(r"^\p{Lu}{2,}$"), F.upper(new)).otherwise(new)
    cases = {
        "email": _email(mention, new, stream, draw),
        "aws": F.concat(F.substring(mention, 1, 4), new),
        "ip": _address(stream),
        "title": mention,
    }
    plain = F.when(kind.isin(*NUMBERS, "iban"), _into(mention, new, kind == "iban")).when(kind.startswith("name-") & ~mention.rlike(rf"^{_UNCASED}$"), named).when((kind == "secret") & mention.startswith("sk-"), F.concat(F.lit("sk-"), new)).otherwise(new)
    return reduce(lambda rest, x: F.when(kind == x[0], x[1]).otherwise(rest), reversed(cases.items()), plain)


def _all_patterns(known: Column) -> Column:
    """ENTITY, and after it the known surnames, for rows that have some."""
    own = F.array_join(F.transform(F.concat(known, F.transform(known, F.upper)), lambda w: F.regexp_replace(w, "-", "[-]")), "|")
    return F.concat(F.lit(f"{ENTITY}|{_BEFORE}(?:"), own, F.lit(f"){_AFTER}"))


def find(docs: DataFrame, text: str = "text", out: str = "mentions", known: str = "known") -> DataFrame:
    """docs with the array<string> of all mentions, in order, in the column `out`, and of the surnames among them in `known`.

    A surname that stands with a title, a given name or after a cue somewhere in the
    text is a mention wherever it stands alone in it, in capitals too.
    """
    none = F.array().cast("array<string>")
    first = F.when(F.col(text).rlike(HINT), F.regexp_extract_all(F.col(text), F.lit(ENTITY), F.lit(0))).otherwise(none)
    rows = docs.withColumn(out, F.coalesce(first, none))
    names = F.filter(out, lambda m: m.rlike(r"^\p{Lu}\S* \p{Lu}") & (kind_of(m) == "name"))
    rows = rows.withColumn(known, F.array_distinct(F.filter(F.transform(names, lambda m: F.element_at(F.split(m, " "), -1)), lambda w: (F.length(w) > 2) & (_given_part(w) == "n"))))
    return rows.withColumn(out, F.when(F.size(known) > 0, F.regexp_extract_all(F.col(text), _all_patterns(F.col(known)), F.lit(0))).otherwise(F.col(out)))


def draws(mentions: DataFrame, key: str, column: str = "mentions", known: str = "known") -> DataFrame:
    """(kind, canonical, draw) of every distinct atom whose first surrogate can't be used.

    A surrogate can't be used if a distinct atom has it too, of whatever kind (the
    first in order of draws and names keeps it), or if it is itself an atom that
    occurs. Atoms draw again until all differ.
    """
    own = mentions.select(F.explode(F.flatten(atoms(F.col(column), F.col(known)))).alias("a")).select("a.kind", "a.canonical").where(F.col("kind") != "title")
    table = checkpointed(own.distinct().withColumn("draw", F.lit(0)))
    taken = table.select(F.col("canonical").alias("surrogate"), F.lit(True).alias("real")).distinct()
    for _ in range(MAX_DRAWS):
        atom = F.array(F.struct(F.col("canonical").alias("word"), "kind", "canonical"))
        made = F.get(surrogates(atom, lambda k, c: F.col("draw"), key), F.lit(0))
        offered = table.withColumn("made", made).withColumn("surrogate", canonical_of(F.col("kind"), F.col("made")))
        first = Window.partitionBy("surrogate").orderBy("draw", "canonical", "kind")
        checked = offered.withColumn("place", F.row_number().over(first)).join(taken, "surrogate", "left")
        bad = (F.col("place") > 1) | F.coalesce(F.col("real"), F.lit(False))
        checked = checkpointed(checked.select("kind", "canonical", "draw", bad.alias("bad")))
        if checked.where("bad").isEmpty():
            return table.where(F.col("draw") > 0).select("kind", "canonical", "draw")
        table = checked.select("kind", "canonical", (F.col("draw") + F.col("bad").cast("int")).alias("draw"))
    raise ValueError(f"no distinct surrogates after {MAX_DRAWS} draws")


def session_key(spark: SparkSession) -> str:
    """The secret key that the session setting gridloom.pii.key names."""
    key = spark.conf.get("gridloom.pii.key", None)
    if not key:
        raise ValueError("surrogates need a secret key: pass one or set gridloom.pii.key")
    return key


def pseudonymise(docs: DataFrame, key: str | None = None, text: str = "text", mentions: str | None = None) -> DataFrame:
    """docs with every entity of the text replaced by its surrogate.

    key is secret: who has it can rebuild the surrogates. Without one, that of the
    session is taken. mentions, if given, names a column for what was found (replaced if there). Null
    texts stay null, empty ones empty. Equal texts get equal results, so repeated
    rows and ids need no care; an empty table stays empty. All texts of the table
    together decide which surrogates differ.
    """
    key = key or session_key(docs.sparkSession)
    name = mentions or free_name(docs, "mentions")
    if mentions:
        docs = docs.drop(mentions)
    known = free_name(docs, "known")
    found = find(docs, text, name, known)
    again = draws(found.where(F.size(name) > 0).select(F.col(name).alias("mentions"), F.col(known).alias("known")), key)
    none = F.array().cast("array<struct<kind:string,canonical:string,draw:int>>")
    redrawn = free_name(docs, "redrawn")
    if again.isEmpty():
        rows = found.withColumn(redrawn, none)
    else:
        digest = free_name(docs, "digest")
        found = found.withColumn(digest, F.when(F.size(name) > 0, F.sha2(F.col(text).cast("binary"), 256)))
        held = found.where(F.size(name) > 0).select(F.col(digest).alias("d"), F.explode(F.flatten(atoms(F.col(name), F.col(known)))).alias("a")).select("d", "a.kind", "a.canonical").distinct()
        lists = held.join(again, ["kind", "canonical"]).groupBy("d").agg(F.collect_list(F.struct("kind", "canonical", "draw")).alias("l"))
        lists = lists.select(F.col("d").alias(digest), F.col("l").alias(redrawn))
        joined = found.where(F.size(name) > 0).join(lists, digest, "left").withColumn(redrawn, F.coalesce(redrawn, none))
        rows = joined.unionByName(found.where(F.size(name) == 0).withColumn(redrawn, none)).drop(digest)

    def draw_of(kind: Column, canonical: Column) -> Column:
        hit = F.get(F.filter(redrawn, lambda r: (r["kind"] == kind) & (r["canonical"] == canonical)), F.lit(0))
        return F.coalesce(hit["draw"], F.lit(0))

    new_words = F.transform(atoms(F.col(name), F.col(known)), lambda words: F.array_join(surrogates(words, draw_of, key), " "))
    gaps = F.when(F.size(known) > 0, F.split(F.col(text), _all_patterns(F.col(known)), -1)).otherwise(F.split(F.col(text), ENTITY, -1))
    new = F.array_join(F.flatten(F.zip_with(gaps, new_words, lambda g, s: F.array(g, F.coalesce(s, F.lit(""))))), "")
    rows = rows.withColumn(text, F.when(F.size(name) > 0, new).otherwise(F.col(text))).drop(redrawn, known)
    return rows if mentions else rows.drop(name)
