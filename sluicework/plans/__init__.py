"""Plans over fleets of texts and documents, and data flows."""

from sluicework.plans.audit_query import audit_queries, judge_queries  # noqa: F401
from sluicework.plans.audit_rule import audit_rules, judge_rules  # noqa: F401
from sluicework.plans.rollup import findings_by_code, totals_of_marks, verdict, verdict_of_marks  # noqa: F401
from sluicework.plans.routing import flow_pairs, run_flows  # noqa: F401
from sluicework.plans.fleet_flows import fleet_rows, flow_table, routed, run_fleet  # noqa: F401
from sluicework.plans.daily_codes import codes_of_days, codes_of_range  # noqa: F401
from sluicework.plans.distinct_bodies import judge_distinct  # noqa: F401
