"""Common table expressions of the check SQL, written independently of the DataFrame code."""

from __future__ import annotations

_COUNTRY = "case {0} % 4 when 0 then 'BR' when 1 then 'US' when 2 then 'GB' else 'FR' end"


def half_up(value: str, digits: int) -> str:
    scale = f"{10**digits}.0::double"
    return f"(floor(({value}) * {scale} + 0.5::double) / {scale})"


def half_even(value: str, digits: int) -> str:
    return f"(format('{{:.{digits}f}}', ({value})::double)::double + 0.0)"


def exact_mean(value: str) -> str:
    return f"(sum(({value})::decimal(20,6))::double / count({value})::double)"


def steady(value: str) -> str:
    """Four decimals, cut off the grid that means of cents lie on, so that last-bit noise of a sum of
    doubles does not decide the last digit."""
    return f"(floor(({value}) * 1e4::double + 0.3::double) / 1e4::double)"


def _plain(label: str) -> str:
    return (f"case when {label} is null or trim({label}) = '' then 'Outros' when {label} = 'Eletrônicos' then 'Eletronicos' "
            f"when {label} = 'Alimentação' then 'Alimentacao' when {label} = 'Vestuário' then 'Vestuario' "
            f"when {label} = 'Serviços' then 'Servicos' else {label} end")


def rule_score(amount: str = "amount", payment: str = "payment_method", category: str = "merchant_category") -> str:
    credit = f"upper({payment}) = 'CREDIT_CARD'"
    return f"""greatest(
  least(1.0::double, 0.07::double + least(0.30::double, ln(1.0::double + greatest({amount}, 0.0::double)) / 13.0::double)
    + case when is_international = 1 then 0.10::double else 0.0::double end
    + case when hour < 6 or hour > 22 then 0.08::double else 0.0::double end
    + case when is_weekend = 1 then 0.05::double else 0.0::double end
    + case when {credit} then 0.08::double else 0.0::double end
    + case when {_plain(category)} = 'Eletronicos' then 0.06::double else 0.0::double end
    + case when {amount} >= 8000 then 0.04::double else 0.0::double end
    + case when is_international = 1 and {credit} and {amount} >= 5000 then 0.04::double else 0.0::double end),
  case when {amount} >= 42000 and is_international = 1 and is_weekend = 1 and {credit} and (hour < 6 or hour > 22) then 0.76::double
       when {amount} >= 40000 and is_international = 1 and is_weekend = 1 and {credit} then 0.74::double else 0.0::double end)"""


POLICY = f"""{half_up('score', 4)} fraud_score, not (score < 0.60::double) is_fraud,
  case when score < 0.60::double then case when score >= 0.3::double then 'MEDIUM' else 'LOW' end
       when score <= 0.75::double then 'HIGH' else 'CRITICAL' end risk_level,
  case when score < 0.60::double then 'APPROVE' when score <= 0.75::double then 'REVIEW' else 'BLOCK' end recommended_action,
  case when score < 0.60::double then 'RELEASED' else 'OPEN' end review_status"""

_CPF_1 = "(" + "+".join(f"{10 - i} * substr({{0}}, {i + 1}, 1)::int" for i in range(9)) + ")"
_CPF_2 = "(" + "+".join(f"{11 - i} * substr({{0}}, {i + 1}, 1)::int" for i in range(9)) + ")"


def _digit(total: str) -> str:
    return f"(case when 11 - ({total}) % 11 >= 10 then 0 else 11 - ({total}) % 11 end)"


def cpf_digits_sql(source: str, base9: str, keep: str) -> str:
    """Eleven ``digits`` from nine, of a table with the columns ``keep``."""
    return f"""select {keep}, ten || {_digit(_CPF_2.format('ten') + ' + 2 * substr(ten, 10, 1)::int')} digits
from (select *, {base9} || {_digit(_CPF_1.format(base9))} ten from {source})"""


# name -> (body, names it reads)
_PARTS: dict[str, tuple[str, tuple[str, ...]]] = {
    "tx": (f"""
select concat_ws('-', l.l_orderkey, l.l_linenumber) transaction_id, concat('user_', o.o_custkey) user_id,
  case when l.l_orderkey % 97 = 0 then null when l.l_orderkey % 101 = 0 then -l.l_extendedprice else l.l_extendedprice end amount,
  case when l.l_orderkey % 7 = 0 then 'USD' else 'BRL' end currency, concat('merchant_', l.l_suppkey) merchant_id,
  case when l.l_orderkey % 89 = 0 then null else case p.p_type when 'ECONOMY' then 'Eletrônicos' when 'SMALL' then 'Alimentacao'
    when 'MEDIUM' then 'Vestuario' when 'PROMO' then 'Servicos' when 'STANDARD' then 'Viagem' else 'Entretenimento' end end merchant_category,
  o.o_orderdate + to_hours(cast(l.l_orderkey % 24 as int)) ts,
  {_COUNTRY.format('c.c_nationkey')} user_country, {_COUNTRY.format('s.s_nationkey')} merchant_country,
  case when l.l_linestatus = 'O' then 'DEBIT_CARD' else 'CREDIT_CARD' end payment_method, l.l_returnflag = 'R' is_fraud,
  l.l_quantity processing_time_ms
from lineitem l join orders o on l.l_orderkey = o.o_orderkey join customer c on o.o_custkey = c.c_custkey
join supplier s on l.l_suppkey = s.s_suppkey join part p on l.l_partkey = p.p_partkey""", ()),
    "deduped": ("""
select * exclude (place) from (
  select *, row_number() over (partition by transaction_id order by ts asc nulls first, amount desc nulls last,
    merchant_id asc nulls first, merchant_category asc nulls first, payment_method asc nulls first, currency asc nulls first,
    is_fraud asc nulls first, merchant_country asc nulls first, processing_time_ms asc nulls first, user_country asc nulls first,
    user_id asc nulls first) place from tx) where place = 1""", ("tx",)),
    "clean": ("""
select transaction_id, user_id, greatest(coalesce(amount, 0.0::double), 0.0::double) amount, currency, merchant_id,
  coalesce(merchant_category, 'UNKNOWN') merchant_category, ts, coalesce(user_country, 'UNKNOWN') user_country, merchant_country,
  payment_method, is_fraud, processing_time_ms, cast(ts as date) transaction_date, cast(hour(ts) as int) transaction_hour
from deduped""", ("deduped",)),
    "featured": ("""
select *, case when isodow(ts) >= 6 then 1 else 0 end is_weekend, case when transaction_hour < 6 then 1 else 0 end is_night,
  cast(month(ts) as int) transaction_month from clean""", ("clean",)),
    "user_stats": ("""
select user_id, avg(amount) user_avg_amount, count(*) user_total_transactions, stddev_samp(amount) user_amount_stddev
from clean group by user_id""", ("clean",)),
    "merchant_stats": ("""
select merchant_id, count(*) merchant_transaction_count, avg(amount) merchant_avg_amount from clean group by merchant_id""",
                       ("clean",)),
    "prow": ("""
select user_id, coalesce(amount, 0.0::double) amount, cast(hour(ts) as int) as hour, coalesce(merchant_category, 'Outros') merchant_category,
  payment_method, case when user_country <> merchant_country then 1 else 0 end abroad, case when is_fraud then 1 else 0 end fraud
from tx""", ("tx",)),
    "p95": (f"""
select user_id, {half_even('amount', 2)} p95_amount from (
  select user_id, amount, row_number() over (partition by user_id order by amount) place, count(*) over (partition by user_id) n
  from prow) where place = greatest(1, cast(floor(n * 0.95::double) as bigint))""", ("prow",)),
    "top_categories": ("""
select user_id, list(merchant_category order by place) typical_categories from (
  select user_id, merchant_category, row_number() over (partition by user_id order by count(*) desc, merchant_category) place
  from prow group by user_id, merchant_category) where place <= 5 group by user_id""", ("prow",)),
    "top_payments": ("""
select user_id, list(payment_method order by place) typical_payment_methods from (
  select user_id, payment_method, row_number() over (partition by user_id order by count(*) desc, payment_method) place
  from prow group by user_id, payment_method) where place <= 3 group by user_id""", ("prow",)),
    "prof": (f"""
select b.user_id, tx_count, avg_amount, std_amount, max_amount, p95_amount, min_amount, typical_categories, typical_payment_methods,
  pct_international, avg_hour, historical_fraud_rate from (
  select user_id, count(*) tx_count, {half_even(exact_mean('amount'), 2)} avg_amount, {half_even('stddev_pop(amount)', 2)} std_amount,
    {half_even('max(amount)', 2)} max_amount, {half_even('min(amount)', 2)} min_amount, {half_even('avg(abroad)', 4)} pct_international,
    {half_even('avg(hour)', 1)} avg_hour, {half_even('avg(fraud)', 4)} historical_fraud_rate from prow group by user_id) b
join p95 on b.user_id = p95.user_id join top_categories c on b.user_id = c.user_id join top_payments m on b.user_id = m.user_id""",
             ("prow", "p95", "top_categories", "top_payments")),
    "req": ("""
select transaction_id, user_id, coalesce(amount, 0.0::double) amount, coalesce(merchant_category, 'Outros') merchant_category, user_country,
  merchant_country, payment_method, cast(hour(ts) as int) as hour, case when isodow(ts) >= 6 then 1 else 0 end is_weekend,
  case when user_country <> merchant_country then 1 else 0 end is_international, ts, processing_time_ms from tx""", ("tx",)),
    "heur": (f"select *, {POLICY} from (select *, {rule_score()} score from req)", ("req",)),
    "ctx": (f"""
select r.*, {_plain('r.merchant_category')} category, p.user_id is not null profile_found, p.tx_count n, p.avg_amount, p.std_amount, p.p95_amount,
  p.avg_hour, p.typical_categories, p.typical_payment_methods,
  case when n >= 5 then 1.0::double when n >= 3 then 0.88::double when n = 2 then 0.72::double when n = 1 then 0.58::double else 1.0::double end confidence,
  case when n >= 5 then 1.0::double when n >= 3 then 0.55::double else 0.0::double end scale,
  r.amount > p.avg_amount + (case when n >= 5 then 2.5::double when n >= 3 then 2.9::double else 3.4::double end) * greatest(p.std_amount, 1.0::double) far_above,
  r.amount > p.p95_amount * (case when n < 5 then 1.08::double else 1.0::double end) above_p95,
  n >= 3 and not (list_contains(p.typical_categories, category)
     or list_contains(list_transform(p.typical_categories, lambda x: {_plain('x')}), category)) new_category,
  n >= 3 and not list_contains(p.typical_payment_methods, r.payment_method) new_payment,
  n >= 5 and abs(r.hour - p.avg_hour) >= 6 odd_hour
from req r left join prof p on r.user_id = p.user_id""", ("req", "prof")),
    "anomaly": (f"""
select *, case when profile_found then {half_up('''least(0.22::double,
    case when far_above then 0.15::double * confidence when above_p95 then 0.09::double * confidence else 0.0::double end
    + case when new_category then 0.06::double * scale else 0.0::double end + case when new_payment then 0.05::double * scale else 0.0::double end
    + case when odd_hour then 0.04::double else 0.0::double end)''', 4)} else 0.0::double end boost,
  list_filter([
    case when far_above then format('Valor R$ {{:.2f}} acima do padrao historico (media R$ {{:.2f}}, p95 R$ {{:.2f}})', amount, avg_amount, p95_amount)
         when above_p95 then format('Valor acima do P95 historico (R$ {{:.2f}})', p95_amount) end,
    case when new_category then concat('Categoria ''', category, ''' atipica para o usuario (historico: [', array_to_string(typical_categories, ', '), '])') end,
    case when new_payment then concat('Meio de pagamento ''', payment_method, ''' incomum no historico') end,
    case when odd_hour then format('Horario {{}}h distante do padrao (media {{:.1f}}h)', hour, avg_hour) end],
    lambda x: x is not null) reasons
from ctx""", ("ctx",)),
    "scored": (f"""
select transaction_id, user_id profile_user_id, amount, merchant_category, payment_method, user_country, merchant_country,
  {POLICY}, reasons anomaly_reasons, profile_found, processing_time_ms, ts, 'PENDING' cosmos_sync_status
from (select *, case when boost > 0 then least(1.0::double, base + boost) else base end score
  from (select *, {rule_score()} base from anomaly))""", ("anomaly",)),
    "alerts": ("""
select transaction_id, fraud_score, risk_level, amount, ts, 'OPEN' status from scored where is_fraud""", ("scored",)),
    "ev": ("""
select concat('evt-', event_id) transaction_id, concat('user_', user_id) user_id, value amount,
  concat('merchant_', json_extract_string(props, '$.k')) merchant_id, event_type merchant_category, ts from events""", ()),
    "people0": ("""
select *, lpad(c_custkey::varchar, 9, '0') base9, lpad((c_custkey * 7919 % 100000000)::varchar, 8, '0') tail,
  c_custkey::varchar key_text from customer""", ()),
    "people1": (f"select *, base9 || {_digit(_CPF_1.format('base9'))} ten from people0", ("people0",)),
    "people2": (f"select *, ten || {_digit(_CPF_2.format('ten') + ' + 2 * substr(ten, 10, 1)::int')} digits from people1", ("people1",)),
    "people": ("""
select concat('user_', key_text) user_id, c_mktsegment segment, base9 cpf_base,
  case c_nationkey % 5 when 0 then digits when 1 then base9 else substr(digits, 1, 3) || '.' || substr(digits, 4, 3) || '.'
    || substr(digits, 7, 3) || '-' || substr(digits, 10, 2) end cpf,
  case c_nationkey % 6 when 0 then lower(c_mktsegment) when 1 then 'u@host' || key_text
    else lower(c_mktsegment) || '.' || key_text || '@banco' || c_nationkey || '.com.br' end email,
  case c_nationkey % 4 when 0 then '(11) 9' || left(tail, 4) || '-' || right(tail, 4) when 1 then '11 ' || tail
    when 2 then '+55 11 9' || tail else tail end phone,
  case c_nationkey % 3 when 0 then replace(c_name, '#', ' ')
    when 1 then 'Ana ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || ' S' else '  ' end "name",
  case c_nationkey % 3 when 0 then '4' || lpad(key_text, 15, '0') when 1 then '5000 ' || left(tail, 4) || ' ' || right(tail, 4) || ' 1234'
    else '123' end card_number, digits
from people2""", ("people2",)),
    "masked": ("""
select *,
  case when length(regexp_replace(cpf, '[^0-9]', '', 'g')) = 11 then '***.' || substr(regexp_replace(cpf, '[^0-9]', '', 'g'), 4, 3) || '*.'
    || substr(regexp_replace(cpf, '[^0-9]', '', 'g'), 8, 2) || '-' || substr(regexp_replace(cpf, '[^0-9]', '', 'g'), 10, 2) else cpf end m_cpf,
  case when contains(email, '@') then
    case when length(split_part(email, '@', 1)) > 1 then email[1] || repeat('*', length(split_part(email, '@', 1)) - 1) else '*' end
    || '@' || split_part(email, '@', 2)[1] || '***' || case when contains(split_part(email, '@', 2), '.')
      then substr(split_part(email, '@', 2), instr(split_part(email, '@', 2), '.')) else '' end else email end m_email,
  case when length(ph) < 10 then phone when length(ph) = 11 then '(' || left(ph, 2) || ') ' || substr(ph, 3, 1) || '****-' || right(ph, 4)
    else '(' || left(ph, 2) || ') ****-' || right(ph, 4) end m_phone,
  array_to_string(list_transform(list_filter(string_split_regex(trim("name"), '\\s+'), lambda w: w <> ''),
    lambda w: case when length(w) > 1 then w[1] || repeat('*', length(w) - 1) else '*' end), ' ') m_name,
  case when length(cd) < 4 then card_number when contains(card_number, ' ')
    then trim(regexp_replace(repeat('*', length(cd) - 4) || right(cd, 4), '(.{4})', '\\1 ', 'g'))
    else repeat('*', length(cd) - 4) || right(cd, 4) end m_card,
  case when length(cd) < 4 then '****' else '**** ' || right(cd, 4) end m_last4
from (select *, regexp_replace(phone, '[^0-9]', '', 'g') ph, regexp_replace(card_number, '[^0-9]', '', 'g') cd from people)""", ("people",)),
}


def with_parts(*names: str) -> str:
    """``with`` clause for the named expressions and everything they read."""
    ordered: list[str] = []

    def visit(name: str) -> None:
        for needed in _PARTS[name][1]:
            visit(needed)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        visit(name)
    return "with " + ",\n".join(f"{n} as ({_PARTS[n][0].strip()})" for n in ordered) + "\n"
