"""Pages from the stochastic grammar (G5). The oracle writes the same productions out in SQL."""

from __future__ import annotations

from cohortkit import constants as K
from cohortkit.operators import grammar as GR
from cohortkit.operators import pages as PG
from cohortkit.plans.q_generate import md5_sql, slot_sql
from cohortkit.plans.q_pages import PAGE_TYPE_SQL, TITLE_SQL, _contract_sql
from cohortkit.plans.registry import register
from cohortkit.plans.sqlviews import view, with_views
from cohortkit.sources.tables import load


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _symbol(name: str, path: str, given: dict[str, str]) -> str:
    if name in given:
        return given[name]
    rules = GR.GRAMMAR[name]
    draw = slot_sql(md5_sql("page_id", _text(path)), 0)
    total, upto, cases = sum(w for w, _ in rules), 0, []
    for i, (weight, production) in enumerate(rules):
        upto += weight
        cases.append(f"WHEN {draw} % {total} < {upto} THEN {_production(production, f'{path}.{i}', given)}")
    return f"(CASE {' '.join(cases)} END)"


def _production(production: str, path: str, given: dict[str, str]) -> str:
    parts = [_text(p) if kind == "text" else _symbol(p, f"{path}/{i}", given) for i, (kind, p) in enumerate(GR.parts_of(production))]
    return "(" + (" || ".join(parts) or "''") + ")"


_CORE = "CASE page_type " + " ".join(f"WHEN '{t}' THEN {_symbol(t, 'core', {'subject': 's'})}" for t in K.PAGE_TYPES) + " END"
view("varied_pages_v", f"""
SELECT page_id AS sample_id, page_type, {_production(GR.PAGE, 'page', {'subject': 's', 'core': 'core'})} AS html,
       {_symbol('summary', 'summary', {'subject': 's'})} AS summary
FROM (SELECT *, {_CORE} AS core FROM (SELECT page_id, {PAGE_TYPE_SQL} AS page_type, coalesce({TITLE_SQL}, '') AS s FROM pages) t) c
""")


@register("gen_pages_grammar", with_views("SELECT * FROM varied_pages_v", "varied_pages_v"))
def q_gen_pages_grammar(spark, sf_dir):
    return GR.generate_varied_pages(load(spark, sf_dir, "pages", "page_id", "html"))


@register("grammar_contract_audit", with_views(f"""
SELECT page_type, count(*) AS n_pages, count(*) FILTER (WHERE {_contract_sql('html', 'page_type')}) AS n_pass,
       round(count(*) FILTER (WHERE {_contract_sql('html', 'page_type')}) / count(*), 6) AS pass_rate
FROM varied_pages_v GROUP BY page_type""", "varied_pages_v"))
def q_grammar_contract_audit(spark, sf_dir):
    """The page contract over the pages of the grammar."""
    return PG.contract_audit(q_gen_pages_grammar(spark, sf_dir))
