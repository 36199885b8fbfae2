"""Operator 2: surrogates for personal data. DataFrame and SQL functions only.

Entities (mail addresses, phone numbers, IPv4 addresses, card-like and social security numbers, IBANs, hexadecimal
secrets, and persons after a title) are found by one regular expression and replaced in place; all other text stays. The
full names and surnames that a text gives with a title are entities wherever else they stand in it.
A surrogate is a keyed function (SHA-256 of the key, the kind, the normalised entity and an attempt number) of the
entity alone, so every mention of one entity, however written, gets one surrogate (coreference). It is of the same kind,
script and format: letters become letters of their script and case, digits digits, separators stay; a number that passed
the Luhn test still does; phone numbers keep their country calling code, mail addresses their top-level domain; a person's given
name follows the gender of the title (of any title that the text gives the name), and a surname has one surrogate whoever
bears it. Phone numbers are found with a
country code (+ or 00), with or without separators, and without one in the North American form (3-3-4 digits, area
code and exchange from 2 on where no bracket or plus marks them; a leading 1 is the same number).

Collision check: the distinct entities of the whole table with their surrogates are grouped; where two entities share a
surrogate, or a surrogate is itself an entity of the table, the attempt number goes up until neither is so. Surnames are
entities of their own, and given names are checked among the bearers of one surname with an attempt number of their
own, so that titles and given names never change a surname. Each attempt widens the space of names (a syllable, or a
hyphenated given name, more), later ones that of mail addresses (a digit more). If ``ATTEMPTS`` do not part the
entities, an error is raised. Those few exceptions are written to a table and joined back by document; without any, no
text is shuffled.

A null text stays null and an empty one empty; repeated rows get equal texts; extra columns, whatever their names, are
kept; texts of any length are replaced whole; an empty table gives an empty table. Rows with a null id are replaced as all others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspark.llm.common import write_out

KEY = "loomspark-surrogates"
ATTEMPTS = 50

#: Titles by gender.
MALE_TITLES = ("Mr", "Herr", "Señor", "Sr", "Monsieur", "Signor", "г-н")
FEMALE_TITLES = ("Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme", "Signora", "г-жа")
OTHER_TITLES = ("Dr", "Prof")

#: Given names by script and gender, and syllables of surnames by script.
NAMES = {
    "latin_m": "Adrian Albert Anton Bruno Carl Daniel Eric Felix Gabriel Hugo Jonas Julian Leo Lucas Martin Oscar Paul Robert Simon Victor",
    "latin_f": "Alice Amelia Anna Bella Clara Diana Elena Emma Eva Flora Helena Ida Julia Laura Lena Maria Nora Olivia Sofia Vera",
    "latin_x": "Alex Andrea Charlie Dominique Kim Noel Robin Sascha",
    "cyrillic_m": "Антон Борис Виктор Игорь Иван Олег Павел Роман Сергей Юрий",
    "cyrillic_f": "Алла Анна Вера Галина Елена Ирина Марина Нина Ольга Юлия",
    "cyrillic_x": "Саша Валя Женя",
    "greek_m": "Ανδρέας Γιώργος Δημήτρης Κώστας Νίκος Παύλος Πέτρος Σπύρος Στέφανος Χρήστος",
    "greek_f": "Άννα Βασιλική Γεωργία Δήμητρα Ειρήνη Ελένη Κατερίνα Μαρία Σοφία Χριστίνα",
    "greek_x": "Άλεξ Φώτης Χρυσή",
}
SYLLABLES = {
    "latin": "ba be bo da de do fa fe ga go ha he ka ke ko la le lo ma me mo na ne no pa pe po ra re ro sa se so ta te to va ve vo za",
    "cyrillic": "ба бе бо ва ве во га го да де до за зе ка ке ко ла ле ло ма ме мо на не но па пе по ра ре ро са се со та те то",
    "greek": "βα γα δα δε δο ζα θα θε κα κε κο λα λε λο μα με μο να νε νο πα πε πο ρα ρε ρο σα σε σο τα τε το φα χα",
}

_TITLE = "|".join(sorted(MALE_TITLES + FEMALE_TITLES + OTHER_TITLES, key=len, reverse=True))
#: Particles of surnames.
PARTICLES = ("al", "bin", "da", "de", "del", "della", "den", "der", "di", "dos", "du", "la", "le", "van", "von")
_NAME = r"(?:\p{Lu}['’])?\p{Lu}\p{L}+(?:-\p{Lu}\p{L}+)*+"
_NAMES = rf"(?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME}(?: (?:(?:{'|'.join(PARTICLES)}) ){{0,3}}{_NAME})?"
_GAP = r"[ .%$#*&!|-]{1,6}"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"

PATTERN = "|".join(
    (
        r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]+(?:\.[\p{L}\p{N}-]+)+",
        r"(?<![\p{L}\p{N}])[0-9a-fA-F]{32,128}(?![\p{L}\p{N}])",
        rf"(?<![0-9.]){_OCTET}(?:\.{_OCTET}){{3}}(?!\.?[0-9])",
        rf"(?:\+|(?<![\p{{L}}\p{{N}}.+-])00)[0-9]{{1,3}}{_GAP}\(?[0-9]{{1,4}}\)?{_GAP}[0-9]{{3,4}}[ .-]?[0-9]{{3,4}}(?![0-9])",
        r"(?<![\p{L}\p{N}])\+[1-9][0-9]{8,14}(?![0-9])",
        r"(?<![\p{L}\p{N}.+-])00[1-9][0-9]{8,11}(?![\p{L}\p{N}])",
        r"\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])",
        r"(?<![\p{L}\p{N}._+-])(?:1[ .-]?)?[2-9][0-9]{2}(?:[2-9][0-9]{6}|[ .-][2-9][0-9]{2}[ .-][0-9]{4})(?![\p{L}\p{N}_-]|\.[0-9])",
        r"(?<![0-9])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])",
        r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?(?![\p{L}\p{N}])",
        r"(?<![0-9])(?:[0-9]{13,19}|[0-9]{4}(?:[ -][0-9]{4}){3})(?![0-9])",
        r"(?<![\p{L}\p{N}])[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}(?![\p{L}\p{N}])",
        TITLED := rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_NAMES}(?![\p{{L}}\p{{N}}])",
    )
)


def _sql(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _list(words: str) -> str:
    return "array(" + ", ".join(_sql(w) for w in words.split()) + ")"


_KIND = """CASE WHEN contains(r, '@') THEN 'email' WHEN r RLIKE '^([+(]|00[0-9]{1,3}[^0-9]|00[1-9][0-9]{8,11}$)' THEN 'phone' WHEN r RLIKE '^[0-9a-fA-F]{32,}$' THEN 'secret'
 WHEN r RLIKE '^[0-9]{1,3}([.][0-9]{1,3}){3}$' THEN 'ip' WHEN r RLIKE '^[0-9]{3}-[0-9]{2}-[0-9]{4}$' THEN 'ssn'
 WHEN r RLIKE '^(1[ .-]?)?[0-9]{3}[ .-]?[0-9]{3}[ .-]?[0-9]{4}$' THEN 'phone' WHEN r RLIKE '^[0-9 -]+$' THEN 'card'
 WHEN r RLIKE '^[A-Z]{2}[0-9]{2}[A-Z0-9 ]+$' THEN 'iban' ELSE 'person' END"""


def _gender(raw: str) -> str:
    of = lambda titles: _sql("^(?:" + "|".join(titles) + ")[. ]")
    return f"CASE WHEN {raw} RLIKE {of(MALE_TITLES)} THEN 'm' WHEN {raw} RLIKE {of(FEMALE_TITLES)} THEN 'f' ELSE 'x' END"


def _norm(e: str) -> str:
    """What all spellings of an entity share."""
    name = f"concat({_gender(e + '.raw')}, '|', lower(regexp_replace({e}.raw, {_sql(f'^(?:{_TITLE})[.]? ')}, '')))"
    digits = f"regexp_replace({e}.raw, '[^0-9]', '')"
    abroad = f"CASE WHEN {e}.raw RLIKE '^([+]|00)' THEN concat('+', regexp_replace({digits}, '^00', '')) ELSE {digits} END"
    return f"CASE WHEN {e}.kind = 'phone' THEN regexp_replace({abroad}, '^[+]?1([0-9]{{10}})$', '$1') WHEN {e}.kind IN ('ssn', 'card') THEN {digits} WHEN {e}.kind = 'person' THEN {name} WHEN {e}.kind = 'iban' THEN lower(replace({e}.raw, ' ', '')) ELSE lower({e}.raw) END"


#: The letters that a letter may become, by its script; the last line takes the letters of all other scripts.
_ALPHABETS = (
    ("[a-z]", "abcdefghijklmnopqrstuvwxyz"),
    (r"\\p{IsLatin}", "àáâäçèéêëíîïñóôöúûüąćęłńśźżčďěňřšťůž"),
    (r"\\p{IsCyrillic}", "абвгдежзийклмнопрстуфхцчшщыэюя"),
    (r"\\p{IsGreek}", "αβγδεζηθικλμνξοπρστυφχψω"),
    (r"\\p{IsHan}", "山川田木林森石水火金土日月上中下大小高長東西南北青白竹松花春秋"),
    (r"\\p{IsHiragana}", "あいうえおかきくけこさしすせそたちつてとなにぬねのはひふへほまみむめも"),
    (r"\\p{IsKatakana}", "アイウエオカキクケコサシスセソタチツテトナニヌネノハヒフヘホマミムメモ"),
    (r"\\p{IsHangul}", "가나다라마바사아자차카타파하고노도로모보소오조초코토포호"),
    (r"\\p{IsArabic}", "ابتثجحخدذرزسشصضطظعغفقكلمنهوي"),
    (r"\\p{IsHebrew}", "אבגדהוזחטיכלמנסעפצקרשת"),
    (r"\\p{IsDevanagari}", "अआइईउऊएऐओऔकखगघचछजझटठडढणतथदधनपफबभमयरलवशषसह"),
    (r"\\p{IsThai}", "กขคงจฉชซญดตถทธนบปผพฟมยรลวสหอฮ"),
    (r"\\p{L}", "abcdefghijklmnopqrstuvwxyz"),
)
#: Country calling codes of one and two digits; all others have three.
_CALLING_CODES = "[+](?:[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3})"


def _canonical(e: str) -> str:
    """The surrogate of an entity struct (kind, norm, attempt, hex, last) in its normalised form.

    A person's is the given name and the surname of ``last``; a surname (an entity of the collision check only) is its norm.
    """
    value = f"CAST(conv(substring({e}.hex, 2 * pmod(i, 96) + 1, 2), 16, 10) AS INT)"
    ch = f"substring({e}.norm, i, 1)"
    pick = lambda letters: f"substring('{letters}', pmod({value}, {len(letters)}) + 1, 1)"
    letters = " ".join(f"WHEN {ch} RLIKE '{c}' THEN {pick(a)}" for c, a in _ALPHABETS)
    each = lambda body, first="1": f"array_join(transform(sequence({first}, length({e}.norm)), i -> {body}), '')"
    email = each(f"CASE WHEN i > length({e}.norm) - length(substring_index({e}.norm, '.', -1)) THEN {ch} WHEN {ch} RLIKE '[0-9]' THEN {pick('0123456789')} {letters} ELSE {ch} END")
    more = f"array_join(transform(sequence(1, {e}.attempt - 3), i -> {pick('0123456789')}), '')"
    email = f"CASE WHEN {e}.attempt > 3 THEN concat({more}, {email}) ELSE {email} END"
    secret = each(pick("0123456789abcdef"))
    digits = each(pick("0123456789"))
    phone = each(f"CASE WHEN i <= length(regexp_extract({e}.norm, '^{_CALLING_CODES}', 0)) THEN {ch} ELSE {pick('0123456789')} END")
    iban = each(f"CASE WHEN i <= 2 THEN {ch} WHEN {ch} RLIKE '[0-9]' THEN {pick('0123456789')} ELSE {pick('abcdefghijklmnopqrstuvwxyz')} END")
    octet = lambda k: f"CAST(1 + pmod(CAST(conv(substring({e}.hex, {4 * k + 1}, 4), 16, 10) AS INT), 254) AS STRING)"
    ip = f"concat_ws('.', {', '.join(octet(k) for k in range(4))})"
    # The last digit keeps the outcome of the Luhn test: the check digit of the new ones, or any other.
    body = f"concat(substring({e}.norm, 1, 1), array_join(transform(sequence(2, length({e}.norm) - 1), i -> {pick('0123456789')}), ''))"
    luhn = "aggregate(sequence(1, length(b)), 0, (s, i) -> s + (CASE WHEN pmod(length(b) - i, 2) = 0 THEN 2 * CAST(substring(b, i, 1) AS INT) - (CASE WHEN substring(b, i, 1) > '4' THEN 9 ELSE 0 END) ELSE CAST(substring(b, i, 1) AS INT) END))"
    off = f"(CASE WHEN luhn_check({e}.norm) THEN 0 ELSE 1 + pmod(CAST(conv(substring({e}.hex, 189, 4), 16, 10) AS INT), 9) END)"
    card = f"element_at(transform(array({body}), b -> concat(b, CAST(pmod(10 - pmod({luhn}, 10) + {off}, 10) AS STRING))), 1)"
    gender, full = f"substring({e}.norm, 1, 1)", f"(CASE {e}.kind WHEN 'surname' THEN {e}.norm ELSE substring({e}.norm, 3) END)"
    surname = f"substring_index({full}, ' ', -1)"
    script = lambda of: f"(CASE WHEN {of} RLIKE '\\\\p{{IsCyrillic}}' THEN 'cyrillic' WHEN {of} RLIKE '\\\\p{{IsGreek}}' THEN 'greek' ELSE 'latin' END)"
    names = "CASE concat(script, '_', gender) " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in NAMES.items()) + " END"
    names = names.replace("script", script(full)).replace("gender", gender)
    syllables = f"CASE {script(surname)} " + " ".join(f"WHEN '{k}' THEN {_list(v)}" for k, v in SYLLABLES.items()) + " END"
    # Each attempt has one name, or one syllable, more than the last: the space outgrows any number of entities.
    drawn = lambda of, hashed: f"transform({of}, (names, k) -> element_at(names, 1 + pmod(CAST(conv(substring({hashed}, 4 * k + 1, 4), 16, 10) AS INT), size(names))))"
    given = f"array_join({drawn(f'array_repeat({names}, 1 + least({e}.attempt, 40))', e + '.hex')}, '-')"
    last = f"initcap(array_join({drawn(f'array_repeat({syllables}, 4 + least({e}.last_attempt, 12))', e + '.last')}, ''))"
    person = f"CASE WHEN {e}.kind = 'person' AND contains({full}, ' ') THEN concat({given}, ' ', {last}) ELSE {last} END"
    return f"CASE {e}.kind WHEN 'email' THEN {email} WHEN 'secret' THEN {secret} WHEN 'phone' THEN {phone} WHEN 'ssn' THEN {digits} WHEN 'card' THEN {card} WHEN 'iban' THEN {iban} WHEN 'ip' THEN {ip} ELSE {person} END"


def _formatted(e: str) -> str:
    """The canonical surrogate written as the mention was: its separators, its letters' case, its title."""
    ch = f"substring({e}.raw, i, 1)"
    longer = f"greatest(0, length({e}.canonical) - length({e}.raw))"
    new_cased = f"substring({e}.canonical, i + {longer}, 1)"
    cased = f"concat(substring({e}.canonical, 1, {longer}), array_join(transform(sequence(1, length({e}.raw)), i -> CASE WHEN {ch} <> lower({ch}) THEN upper({new_cased}) ELSE {new_cased} END), ''))"
    digits = f"replace({e}.canonical, '+', '')"
    # Digits before those of the normalised form (00, or the 1 of North America) stay.
    spaced = f"aggregate(sequence(1, length({e}.raw)), named_struct('out', '', 'k', 1 + length({digits}) - length(regexp_replace({e}.raw, '[^0-9]', ''))), (s, i) -> CASE WHEN {ch} RLIKE '[0-9]' THEN named_struct('out', concat(s.out, CASE WHEN s.k < 1 THEN {ch} ELSE substring({digits}, s.k, 1) END), 'k', s.k + 1) ELSE named_struct('out', concat(s.out, {ch}), 'k', s.k) END, s -> s.out)"
    title = f"regexp_extract({e}.raw, {_sql(f'^(?:{_TITLE})[.]? ')}, 0)"
    bare = f"substring({e}.raw, 1 + length({title}))"
    titled = f"concat({title}, CASE WHEN {bare} = upper({bare}) THEN upper({e}.canonical) ELSE {e}.canonical END)"
    grouped = f"upper(array_join(transform(sequence(1, length({e}.raw)), i -> CASE WHEN {ch} = ' ' THEN ' ' ELSE substring({e}.canonical, i - length(substring({e}.raw, 1, i)) + length(replace(substring({e}.raw, 1, i), ' ', '')), 1) END), ''))"
    return f"CASE WHEN {e}.kind IN ('phone', 'ssn', 'card') THEN {spaced} WHEN {e}.kind = 'iban' THEN {grouped} WHEN {e}.kind = 'person' THEN {titled} WHEN {e}.kind = 'ip' THEN {e}.canonical ELSE {cased} END"


def _keyed(e: str, attempt: str, last_attempt: str, key: str) -> str:
    part = lambda n, kind, what, tried: f"sha2(concat_ws('|', {_sql(key)}, {kind}, {what}, CAST({tried} AS STRING), '{n}'), 256)"
    own = ", ".join(part(n, e + ".kind", e + ".norm", attempt) for n in range(3))
    return f"{attempt} AS attempt, {last_attempt} AS last_attempt, concat({own}) AS hex, {part('last', _sql('person'), _surname(e), last_attempt)} AS last"


def _surname(e: str) -> str:
    return f"substring_index(CASE {e}.kind WHEN 'surname' THEN {e}.norm ELSE substring({e}.norm, 3) END, ' ', -1)"


def entity_pattern(text: Column) -> Column:
    """The pattern of a text's entities: that of all texts and, where persons have titles, their names without one."""
    names = F.transform(F.regexp_extract_all(text, F.lit(TITLED), F.lit(0)), lambda r: F.regexp_replace(r, f"^(?:{_TITLE})[.]? ", ""))
    surnames = F.transform(names, lambda n: F.substring_index(n, " ", -1))
    # Longer names first, so that a surname does not hide the full name that it ends.
    known = F.array_sort(F.array_distinct(F.concat(names, surnames)), lambda x, y: F.length(y) - F.length(x))
    own = F.concat(F.lit(PATTERN + r"|(?<![\p{L}\p{N}])(?:"), F.array_join(known, "|"), F.lit(r")(?![\p{L}\p{N}])"))
    titled = text.rlike("(?:" + _TITLE + r")\.? ")
    return F.when(titled & (F.size(known) > 0), own).otherwise(F.lit(PATTERN))


def find_entities(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The table with ``pattern``, by which a text is taken apart, and ``found``: an array of (raw, kind, norm), one for each mention in the order of the text."""
    docs = docs.withColumn("pattern", entity_pattern(F.col(text_col)))
    candidates = F.regexp_extract_all(F.col(text_col), F.col("pattern"), F.lit(0))
    none = F.array().cast("array<string>")
    cheap = F.col(text_col).rlike("[0-9]|@|(?:" + _TITLE + ")[. ]")
    found = docs.withColumn("found", F.when(cheap, candidates).otherwise(none))
    found = found.withColumn("found", F.expr(f"transform(found, r -> named_struct('raw', r, 'kind', {_KIND}))"))
    found = found.withColumn("found", F.expr(f"transform(found, e -> named_struct('raw', e.raw, 'kind', e.kind, 'norm', {_norm('e')}))"))
    # A mention that leaves the gender open is of the person whom the text names with one.
    known = "array_distinct(transform(filter(found, o -> o.kind = 'person' AND substring(o.norm, 1, 1) IN ('m', 'f') AND contains(o.norm, ' ')), o -> o.norm))"
    found = found.withColumn("known", F.expr(known))
    told = "coalesce(get(filter(known, n -> substring(n, 3) = substring(e.norm, 3)), 0), e.norm)"
    return found.withColumn("found", F.expr(f"transform(found, e -> named_struct('raw', e.raw, 'kind', e.kind, 'norm', CASE WHEN e.kind = 'person' AND substring(e.norm, 1, 1) = 'x' AND size(known) > 0 THEN {told} ELSE e.norm END))")).drop("known")


def _with_canonical(entities: DataFrame, key: str) -> DataFrame:
    """(kind, norm, attempt) with ``canonical``; a person's has the surname itself, whose surrogate is checked by its own."""
    e = entities.withColumn("e", F.struct("kind", "norm"))
    e = e.withColumn("e", F.expr(f"struct(e.kind AS kind, e.norm AS norm, {_keyed('e', 'attempt', 'attempt', key)})"))
    made = F.expr(f"CASE WHEN kind = 'person' THEN concat(substring_index({_canonical('e')}, ' ', 1), ' ', {_surname('e')}) ELSE {_canonical('e')} END")
    return e.withColumn("canonical", F.lower(made)).drop("e")


def exceptions(found: DataFrame, key: str = KEY) -> DataFrame | None:
    """(kind, norm, attempt) of the entities whose first surrogate collides; None if there are none."""
    seen = found.select(F.explode("found").alias("e")).select("e.kind", "e.norm").distinct()
    # Of persons the surnames, and those with a given name besides.
    checked = F.expr(f"CASE WHEN e.kind = 'person' THEN filter(array(struct('surname' AS kind, {_surname('e')} AS norm), e), x -> x.kind = 'surname' OR contains(x.norm, ' ')) ELSE array(e) END")
    seen = seen.select(F.struct("kind", "norm").alias("e")).select(F.explode(checked).alias("e")).select("e.kind", "e.norm").distinct()
    entities = write_out(_with_canonical(seen.withColumn("attempt", F.lit(0)), key), "entities")
    originals = write_out(entities.where("kind <> 'person'").select("kind", F.col("norm").alias("canonical")).distinct(), "originals")
    for tried in range(ATTEMPTS + 1):
        least = entities.groupBy("kind", "canonical").agg(F.count("*").alias("n"), F.min(F.struct("attempt", "norm")).alias("first")).where("n > 1")
        shared = entities.join(least, ["kind", "canonical"]).where("norm <> first.norm").select("kind", "norm")
        taken = entities.join(originals, ["kind", "canonical"], "left_semi").select("kind", "norm")
        bad = write_out(shared.union(taken).distinct(), "collisions")
        if not bad.limit(1).count():
            break
        if tried == ATTEMPTS:
            raise ValueError(f"surrogates of {bad.count()} entities still collide after {ATTEMPTS} attempts")
        again = entities.join(bad.withColumn("bad", F.lit(1)), ["kind", "norm"], "left")
        entities = write_out(_with_canonical(again.select("kind", "norm", (F.col("attempt") + F.coalesce("bad", F.lit(0))).alias("attempt")), key), "entities")
    odd = entities.where("attempt > 0").select("kind", "norm", "attempt")
    return odd if odd.limit(1).count() else None


def replace_entities(docs: DataFrame, key: str = KEY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with surrogates in its text, and ``n_replaced``."""
    columns = docs.columns
    rows = docs.select(F.col(id_col).alias("own_id"), F.col(text_col).alias("text"), F.struct(*(F.col(f"`{c}`") for c in columns)).alias("row"))
    found = find_entities(rows)
    odd = exceptions(found, key)
    attempt, last_attempt = "0", "0"
    if odd is not None:
        mentions = found.select("own_id", F.explode("found").alias("e")).select("own_id", "e.kind", "e.norm", "e").distinct()
        names = mentions.where("kind = 'person'").select("own_id", F.lit("surname").alias("kind"), F.expr(_surname("e")).alias("norm"))
        mentions = mentions.select("own_id", "kind", "norm").unionByName(names).distinct()
        by_doc = mentions.join(odd, ["kind", "norm"]).groupBy("own_id").agg(F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "kind", "norm"), "attempt"))).alias("attempts"))
        by_doc = write_out(by_doc.withColumnRenamed("own_id", "odd_id"), "attempts")
        found = found.join(by_doc, F.col("own_id").eqNullSafe(F.col("odd_id")), "left")
        attempt = "coalesce(attempts[concat_ws('|', e.kind, e.norm)], 0)"
        last_attempt = f"coalesce(attempts[concat_ws('|', 'surname', {_surname('e')})], 0)"
    steps = F.expr(f"transform(found, e -> struct(e.raw AS raw, e.kind AS kind, e.norm AS norm, {_keyed('e', attempt, last_attempt, key)}))")
    canonical = "CASE WHEN e.kind = 'person' THEN {0} ELSE lower({0}) END".format(_canonical("e"))
    out = found.withColumn("found", steps).withColumn("found", F.expr(f"transform(found, e -> struct(e.raw AS raw, e.kind AS kind, {canonical} AS canonical))"))
    out = out.withColumn("fresh", F.expr(f"transform(found, e -> {_formatted('e')})"))
    parts = F.split(F.col("text"), F.col("pattern"), -1)
    joined = F.array_join(F.flatten(F.zip_with(parts, F.col("fresh"), lambda p, s: F.array(p, F.coalesce(s, F.lit(""))))), "")
    text = F.when(F.size("fresh") > 0, joined).otherwise(F.col("text"))
    return out.select(*(text.alias(c) if c == text_col else F.col(f"row.`{c}`") for c in columns if c != "n_replaced"), F.coalesce(F.size("fresh"), F.lit(0)).alias("n_replaced"))
