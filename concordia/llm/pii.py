"""PII: keyed pseudonyms that keep a value's format.

Candidates are found by one pattern, validated (Luhn, calendar, number ranges), and permuted by a Feistel network over their own format's domain: a card stays a
card with a right check digit, a date a date. Equal values get equal pseudonyms wherever they stand, and whoever has the key can turn them back.
All of it is SQL expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import fresh, table

ROUNDS, BLOCK = 8, 256
#: Years 1800 to 2199: 146,097 days, which is 189 times 773.
FIRST_DAY, DAYS_A, DAYS_B = "1800-01-01", 189, 773
#: Dates after a month's 12th, which alone tell month/day/year from day/month/year: 88,497 of them, 9 times 9,833.
LATE_A, LATE_B = 9, 9833

#: Bounds of the standards (64 for the name, 63 for a label), possessive, and tried once a run: time is linear in the text, and no match recurses by its length.
EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}+\.){1,126}[A-Za-z]{2,63}"
PHONE = r"(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[.-])\d{3}[ .-]\d{4}(?![\w-])|(?<![\w+])\+\d{1,3}(?:[ .-]?\d{2,4}){3,4}(?![\w-])"
SSN = r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"
MONTH = r"(?i:Jan(?:uary)?|Feb(?:ruary)?|Mar(?:ch)?|Apr(?:il)?|May|June?|July?|Aug(?:ust)?|Sep(?:t(?:ember)?)?|Oct(?:ober)?|Nov(?:ember)?|Dec(?:ember)?)"
DAY = r"\d{1,2}(?:st|nd|rd|th)?"
DATE = (
    r"(?<![\w-])\d{4}-\d{2}-\d{2}(?:(?=T\d{2}:?\d{2})|(?![\w-]))"  # a time may stand behind it, and stays
    r"|(?<![\w/.-])(?:\d{4}/\d{1,2}/\d{1,2}|\d{4}[.]\d{1,2}[.]\d{1,2}|\d{1,2}/\d{1,2}/\d{4}|\d{1,2}[.]\d{1,2}[.]\d{4}|\d{1,2}-\d{1,2}-\d{4})(?![\w-]|[/.]\w)"
    rf"|(?<![\w-]){DAY} {MONTH}[.]?,? \d{{4}}(?![\w-])|(?<!\w){MONTH}[.]? {DAY},? \d{{4}}(?![\w-])"
)
IP = r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\w)"
#: A whole run of groups, however long: what stands beside a card is told from it by the check digit. A group that begins another kind ends the run.
GROUPS = r"\d++(?:-\d++)*+(?![\w-])"
CARD = rf"(?<![\w-])(?=\d(?:[ -]?\d){{12}}){GROUPS}(?: (?!{EMAIL}|{DATE}|{SSN}|{PHONE}|{IP}){GROUPS})*+"
SECRET = r"(?<=[\"'=: ])[0-9a-f]{32,64}(?=[\"'\s,;]|\Z)"
KINDS = {"email": EMAIL, "date": DATE, "ssn": SSN, "phone": PHONE, "ip": IP, "card": CARD, "secret": SECRET}
PATTERN = "|".join(KINDS.values())


def _sql(s: str) -> str:
    return "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"


def permuted(a: str, b: str, size_a: str, size_b: str, key: str, kind: str) -> str:
    """SQL for struct(a, b), a Feistel permutation of the pairs 0 <= a < size_a, 0 <= b < size_b: in turn, each is moved by a keyed hash of the other."""
    f = lambda x: f"cast(conv(substr(sha2(concat({_sql(key)}, '|{kind}|', r, '|', {x}), 256), 1, 12), 16, 10) as bigint)"
    return (
        f"aggregate(sequence(1, {ROUNDS}), named_struct('a', cast({a} as bigint), 'b', cast({b} as bigint)), (s, r) -> "
        f"named_struct('a', if(r % 2 = 1, (s.a + {f('s.b')}) % ({size_a}), s.a), 'b', if(r % 2 = 0, (s.b + {f('s.a')}) % ({size_b}), s.b)))"
    )


def permuted_digits(d: str, key: str, kind: str) -> str:
    """SQL for the digits d (2 to 30 of them), permuted within their length."""
    left, right = f"(length({d}) div 2)", f"(length({d}) - length({d}) div 2)"
    p = permuted(f"substr({d}, 1, {left})", f"substr({d}, {left} + 1)", f"cast(pow(10, {left}) as bigint)", f"cast(pow(10, {right}) as bigint)", key, kind + "' || length(" + d + ") || '")
    return f"(array(lpad(cast(({p}).a as string), {left}, '0'), lpad(cast(({p}).b as string), {right}, '0')))"


def refill(match: str, digits: str) -> str:
    """SQL for match with its digits replaced by those given, in order."""
    return f"array_join(aggregate(split({match}, ''), named_struct('i', 1, 'o', cast(array() as array<string>)), (s, c) -> if(c rlike '[0-9]', named_struct('i', s.i + 1, 'o', array_append(s.o, substr({digits}, s.i, 1))), named_struct('i', s.i, 'o', array_append(s.o, c))), s -> s.o), '')"


def luhn_sum(d: str) -> str:
    """SQL for the Luhn sum of digits d, the last of which counts once."""
    return f"aggregate(transform(split(reverse({d}), ''), (c, i) -> if(i % 2 = 1, cast(substr('0246813579', cast(c as int) + 1, 1) as int), cast(c as int))), 0, (s, x) -> s + x)"


def month_first(m: str) -> str:
    """SQL: m is month/day/year, as it can't be day/month/year."""
    return f"({m} rlike '^[0-9]{{1,2}}[-/.][0-9]' and cast(split({m}, '[-/.]')[1] as int) > 12)"


def date_of(m: str) -> str:
    """SQL for the date that m, a match of DATE, writes, or null. What can be day/month/year is."""
    n = f"regexp_replace({m}, '[/.]', '-')"
    month = f"(instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(left(regexp_extract({m}, '[A-Za-z]{{3,}}', 0), 3))) + 2) div 3"
    named = f"try_to_date(concat_ws('-', regexp_extract({m}, '[0-9]{{4}}', 0), {month}, regexp_extract({m}, {_sql(r'(?<![0-9])[0-9]{1,2}(?![0-9])')}, 0)), 'yyyy-M-d')"
    return f"case when {m} rlike '[A-Za-z]{{3}}' then {named} when {m} rlike '^[0-9]{{4}}' then try_to_date({n}, 'yyyy-M-d') when {month_first(m)} then try_to_date({n}, 'M-d-yyyy') else try_to_date({n}, 'd-M-yyyy') end"


def dated(m: str, d: str) -> str:
    """SQL for date d in the layout of m."""
    lone = _sql(r"(?<![0-9])[0-9](?![0-9])")
    sep, two = f"regexp_extract({m}, '[-/.]', 0)", f"if({m} rlike {lone}, 1, 2)"
    year, month, day = f"date_format({d}, 'yyyy')", f"lpad(month({d}), greatest({two}, length(month({d}))), '0')", f"lpad(day({d}), greatest({two}, length(day({d}))), '0')"
    word = f"regexp_extract({m}, '[A-Za-z]{{3,}}', 0)"
    name = f"if(length({word}) > 4 or lower({word}) in ('june', 'july'), date_format({d}, 'MMMM'), date_format({d}, 'MMM'))"
    name = f"case when {word} = upper({word}) then upper({name}) when {word} = lower({word}) then lower({name}) else {name} end"
    ending = f"if({m} rlike '[0-9](st|nd|rd|th)', case when day({d}) in (11, 12, 13) then 'th' when day({d}) % 10 = 1 then 'st' when day({d}) % 10 = 2 then 'nd' when day({d}) % 10 = 3 then 'rd' else 'th' end, '')"
    number = _sql(r"(?<![0-9])[0-9]{1,2}(?![0-9])(?:st|nd|rd|th)?")
    named = f"regexp_replace(regexp_replace(regexp_replace({m}, {number}, concat(if({m} rlike {lone}, cast(day({d}) as string), lpad(day({d}), 2, '0')), {ending})), '[0-9]{{4}}', {year}), '[A-Za-z]{{3,}}', {name})"
    return f"case when {m} rlike '[A-Za-z]{{3}}' then {named} when {m} rlike '^[0-9]{{4}}' then concat_ws({sep}, {year}, {month}, {day}) when {month_first(m)} then concat_ws({sep}, {month}, {day}, {year}) else concat_ws({sep}, {day}, {month}, {year}) end"


def card_pieces(m: str) -> str:
    """SQL for the pieces of a run of digit groups that as a whole is of no kind: its valid cards, longest first from the left, and what is between them."""
    after = "array_join(slice(g, i, k), '')"
    piece = f"regexp_replace({after}, '^[^0-9]+', '')"
    card = f"length(regexp_replace({after}, '[^0-9]', '')) between 13 and 19 and {piece} rlike '^[0-9]([ -]?[0-9]){{12,18}}$' and {valid('card', piece)}"
    longest = f"coalesce(get(filter(sequence(19, 1, -1), k -> i + k - 1 <= size(g) and {card}), 0), 0)"
    put = f"if(k = 0, named_struct('next', i + 1, 'out', array_append(s.out, g[i - 1])), named_struct('next', i + k, 'out', concat(s.out, filter(array(regexp_extract(g[i - 1], '^[^0-9]*', 0), {piece}), y -> y <> ''))))"
    step = f"if(i < s.next, s, element_at(transform(array({longest}), k -> {put}), 1))"
    # in blocks of groups, so that long runs aren't copied for each of their pieces
    block = f"aggregate(sequence(b * {BLOCK} + 1, least(size(g), (b + 1) * {BLOCK})), named_struct('next', o.next, 'out', cast(array() as array<string>)), (s, i) -> {step})"
    greedy = f"aggregate(sequence(0, cast((size(g) - 1) div {BLOCK} as int)), named_struct('next', 1, 'out', cast(array() as array<array<string>>)), (o, b) -> element_at(transform(array({block}), t -> named_struct('next', t.next, 'out', array_append(o.out, t.out))), 1), o -> flatten(o.out))"
    return f"element_at(transform(array(regexp_extract_all({m}, '[^0-9]*[0-9]+', 0)), g -> {greedy}), 1)"


def valid(kind: str, m: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    return {
        "email": "true",
        "secret": f"{m} rlike '[0-9]' and {m} rlike '[a-f]'",
        "date": f"{date_of(m)} between date'{FIRST_DAY}' and date'2199-12-31'",
        "ssn": f"substr({m}, 1, 3) not in ('000', '666') and substr({m}, 1, 1) <> '9' and substr({m}, 5, 2) <> '00' and substr({m}, 8) <> '0000'",
        "phone": f"length({digits}) between 10 and 15",
        "ip": f"forall(split({m}, '[.]'), x -> cast(x as int) <= 255)",
        "card": f"length({digits}) between 13 and 19 and {digits} rlike '[1-9]' and {luhn_sum(digits)} % 10 = 0",
    }[kind]


def pseudonym(kind: str, m: str, key: str) -> str:
    digits = f"regexp_replace({m}, '[^0-9]', '')"
    if kind == "email":
        return f"concat('u', substr(sha2(concat({_sql(key)}, '|email|', lower({m})), 256), 1, 16), '@', substring_index({m}, '@', -1))"
    if kind == "secret":
        return f"substr(concat(sha2(concat({_sql(key)}, '|secret|', {m}), 256)), 1, length({m}))"
    if kind == "date":
        day = f"datediff(d, date'{FIRST_DAY}')"
        p = permuted(f"{day} div {DAYS_B}", f"{day} % {DAYS_B}", str(DAYS_A), str(DAYS_B), key, kind)
        usual = f"element_at(transform(array({p}), x -> date_add(date'{FIRST_DAY}', cast(x.a * {DAYS_B} + x.b as int))), 1)"
        # by months: place among the dates after the 12th; a month has 18.44 of them on average
        place = f"({day} - 12 * ((year(d) - 1800) * 12 + month(d)))"
        p = permuted(f"{place} div {LATE_B}", f"{place} % {LATE_B}", str(LATE_A), str(LATE_B), key, "late date")
        begin = f"(datediff(add_months(date'{FIRST_DAY}', k), date'{FIRST_DAY}') - 12 * k)"
        near = f"sequence(greatest(0, cast(j / 18.436875 as int) - 2), least(4799, cast(j / 18.436875 as int) + 2))"
        late = f"element_at(transform(transform(array({p}), x -> cast(x.a * {LATE_B} + x.b as int)), j -> array_max(transform(filter({near}, k -> {begin} <= j), k -> date_add(add_months(date'{FIRST_DAY}', k), j - {begin} + 12)))), 1)"
        return f"element_at(transform(transform(array({date_of(m)}), d -> if({month_first(m)}, {late}, {usual})), n -> {dated(m, 'n')}), 1)"
    if kind == "ssn":
        area = f"cast(substr({m}, 1, 3) as int)"
        rest = f"((cast(substr({m}, 5, 2) as int) - 1) * 9999 + cast(substr({m}, 8) as int) - 1)"
        p = permuted(f"if({area} > 666, {area} - 2, {area} - 1)", rest, "898", "989901", key, kind)
        return f"element_at(transform(array({p}), x -> concat(lpad(if(x.a + 1 > 665, x.a + 2, x.a + 1), 3, '0'), '-', lpad(x.b div 9999 + 1, 2, '0'), '-', lpad(x.b % 9999 + 1, 4, '0'))), 1)"
    if kind == "ip":
        o = [f"cast(element_at(split({m}, '[.]'), {i}) as int)" for i in (1, 2, 3, 4)]
        p = permuted(f"{o[0]} * 256 + {o[1]}", f"{o[2]} * 256 + {o[3]}", "65536", "65536", key, kind)
        return f"element_at(transform(array({p}), x -> concat_ws('.', x.a div 256, x.a % 256, x.b div 256, x.b % 256)), 1)"
    if kind == "phone":  # the last ten digits; what is before them is the country
        new = f"concat(left({digits}, length({digits}) - 10), array_join({permuted_digits(f'right({digits}, 10)', key, kind)}, ''))"
        return f"element_at(transform(array({new}), n -> {refill(m, 'n')}), 1)"
    # a card keeps its first digit; the check digit follows from the others
    middle = f"substr({digits}, 2, length({digits}) - 2)"
    body = f"concat(left({digits}, 1), array_join({permuted_digits(middle, key, kind)}, ''))"
    whole = f"element_at(transform(array({body}), n -> concat(n, cast((10 - {luhn_sum("concat(n, '0')")} % 10) % 10 as string))), 1)"
    return f"element_at(transform(array({whole}), w -> {refill(m, 'w')}), 1)"


def kind_of(m: str) -> str:
    """SQL for the kind of a match that validates, else null. Kinds in order: a match that one kind's pattern takes whole is never another's."""
    whens = " ".join(f"when {m} rlike {_sql('^(?:' + p + ')$')} and {valid(k, m)} then '{k}'" for k, p in KINDS.items() if k != "secret")
    return f"case {whens} when {m} rlike '^[0-9a-f]{{32,64}}$' and {valid('secret', m)} then 'secret' end"


def pseudonymize(docs: DataFrame, *, key: str, text_col: str = "text") -> DataFrame:
    """docs with its text's personal data replaced, and n_<kind> for each kind and n_pii (long).

    Null text stays null, with no findings. Numbers that fail validation stay as they are. A value across a line break isn't found. Repeated
    rows, null ids and empty tables are fine; columns of any other name stay, one that is named like an added one is replaced. Time is linear in a text's length. No shuffle.
    Whoever has the key can turn pseudonyms back; it is a literal of the plan, which spark.redaction.string.regex can hide."""
    found, pieces, kinds, new_, gaps_ = fresh(docs.columns, "_found", "_pieces", "_kinds", "_new", "_gaps")
    text = F.coalesce(F.col(text_col), F.lit(""))
    # what every kind has somewhere: @, two digits or a digit and a point, or a long hex string
    out = docs.withColumn(found, F.when(text.rlike(r"@|\d[\d.]|[0-9a-f]{32}"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))))
    run = "length(regexp_replace(m, '[^0-9]', '')) >= 13 and m rlike '^[+(]?[0-9][0-9 ().-]*$'"
    out = out.withColumn(pieces, F.expr(f"transform({found}, m -> if({run} and {kind_of('m')} is null, {card_pieces('m')}, array(m)))")).withColumn(found, F.flatten(pieces))
    out = out.withColumn(kinds, F.expr(f"transform({found}, m -> {kind_of('m')})"))
    new = f"case element_at({kinds}, i + 1) " + " ".join(f"when '{k}' then {pseudonym(k, 'm', key)}" for k in KINDS) + " else m end"
    out = out.withColumn(new_, F.expr(f"transform({found}, (m, i) -> {new})"))
    out = out.withColumn(gaps_, F.when(F.size(found) > 0, F.split(text, PATTERN, -1)))
    # no gap between the pieces of one match
    gaps = F.concat(F.flatten(F.transform(pieces, lambda p, i: F.concat(F.array(F.get(F.col(gaps_), i)), F.array_repeat(F.lit(""), F.size(p) - 1)))), F.array(F.element_at(gaps_, -1)))
    joined: Column = F.array_join(F.zip_with(gaps, F.concat(new_, F.array(F.lit(""))), lambda g, n: F.concat(g, n)), "")
    out = out.withColumn(text_col, F.when(F.size(found) > 0, joined).otherwise(F.col(text_col)))
    for k in KINDS:
        out = out.withColumn(f"n_{k}", F.expr(f"cast(coalesce(nullif(size(filter({kinds}, x -> x = '{k}')), -1), 0) as bigint)"))
    out = out.withColumn("n_pii", F.size(F.filter(F.coalesce(kinds, F.array().cast("array<string>")), lambda x: x.isNotNull())).cast("long"))
    return out.drop(found, pieces, kinds, new_, gaps_)


#: The key of the registered query, whose results are compared between runs; a release takes a key of its own, from a secret store.
QUERY_KEY = "key of the op6_pii query"


def op6_pii(spark, sf_dir):
    out = pseudonymize(table(spark, sf_dir, "documents").select("doc_id", "text"), key=QUERY_KEY)
    return out.select("doc_id", "n_pii", *(f"n_{k}" for k in KINDS), "text")
