"""The semantic layer: metrics, statement tables and what queries may name."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import types as T

#: Ordinal of each report period within its year. Q2 is the half year, FY the whole one.
PERIODS = {"Q1": 1, "Q2": 2, "Q3": 3, "FY": 4}
COMMON = ("stock_code", "stock_abbr", "report_period", "report_year")
#: Values beyond this are no financial amounts.
MAX_ABS = 10**15
AMOUNT = T.DecimalType(24, 4)


@dataclass(frozen=True)
class Metric:
    key: str
    label: str
    table: str
    unit: str
    aliases: tuple[str, ...] = ()


#: The metrics that questions can name, their statement, unit and aliases.
METRICS = {
    m.key: m
    for m in (
        Metric("total_profit", "利润总额", "income_sheet", "万元", ("利润总额", "核心利润指标", "亏钱")),
        Metric("net_profit", "净利润", "income_sheet", "万元", ("净利润",)),
        Metric("total_operating_revenue", "营业总收入", "income_sheet", "万元", ("营业总收入", "主营业务收入", "收入", "营收", "销售额")),
        Metric("operating_revenue_yoy_growth", "营业总收入同比增长率", "income_sheet", "%", ("营业总收入同比增长率", "营业总收入同比", "主营业务收入同比增长率", "销售额年同比")),
        Metric("operating_revenue_qoq_growth", "营业总收入环比增长率", "core_performance_indicators_sheet", "%", ("营业总收入环比增长率", "主营业务收入环比增长率", "环比增长率")),
        Metric("asset_liability_ratio", "资产负债率", "balance_sheet", "%", ("资产负债率", "负债总额/资产总额")),
        Metric("operating_cf_net_amount", "经营性现金流量净额", "cash_flow_sheet", "万元", ("经营性现金流量净额", "经营性现金流净额", "经营活动产生的现金流量净额")),
        Metric("operating_expense_rnd_expenses", "研发费用", "income_sheet", "万元", ("研发费用", "营业总支出-研发费用")),
        Metric("operating_expense_selling_expenses", "销售费用", "income_sheet", "万元", ("销售费用", "营业总支出-销售费用")),
        Metric("gross_profit_margin", "销售毛利率", "core_performance_indicators_sheet", "%", ("销售毛利率",)),
        Metric("net_profit_margin", "销售净利率", "core_performance_indicators_sheet", "%", ("销售净利率",)),
        Metric("asset_inventory", "存货", "balance_sheet", "万元", ("存货", "资产-存货")),
        Metric("asset_accounts_receivable", "应收账款", "balance_sheet", "万元", ("应收账款", "资产-应收账款")),
        Metric("equity_unappropriated_profit", "未分配利润", "balance_sheet", "万元", ("未分配利润", "股东权益-未分配利润")),
        Metric("roe_weighted_excl_non_recurring", "加权平均净资产收益率（扣非）", "core_performance_indicators_sheet", "%", ("加权平均净资产收益率（扣非）",)),
        Metric("roe", "净资产收益率", "core_performance_indicators_sheet", "%", ("收益率", "净资产收益率")),
    )
}
#: Fields that can be queried but not asked for in words.
EXTRA_FIELDS = {
    "asset_cash_and_cash_equivalents": "balance_sheet",
    "asset_total_assets": "balance_sheet",
    "liability_total_liabilities": "balance_sheet",
    "liability_short_term_loans": "balance_sheet",
    "equity_total_equity": "balance_sheet",
    "investing_cf_net_amount": "cash_flow_sheet",
    "net_profit_yoy_growth": "core_performance_indicators_sheet",
}
STATEMENTS = ("income_sheet", "balance_sheet", "cash_flow_sheet", "core_performance_indicators_sheet")


class SpecError(ValueError):
    """A query that may not be compiled."""


@dataclass(frozen=True)
class Registry:
    """What queries may name: each metric field's statement, and the comparison operators."""

    fields: dict[str, str] = field(default_factory=lambda: {m.key: m.table for m in METRICS.values()} | EXTRA_FIELDS)
    operators: frozenset[str] = frozenset({"=", ">", "<", ">=", "<="})

    def table_of_metric(self, metric: str) -> str:
        if metric not in self.fields:
            raise SpecError(f"unknown metric {metric!r}")
        return self.fields[metric]

    def resolve(self, name: str, base_table: str) -> str:
        """The statement a field is read from: the base one if it has the field, else its only owner."""
        if base_table not in STATEMENTS:
            raise SpecError(f"unknown table {base_table!r}")
        if name in COMMON:
            return base_table
        if name not in self.fields:
            raise SpecError(f"unknown field {name!r}")
        return self.fields[name]


def period_type(table: str) -> str:
    """Balance sheets hold a state, all others what has run up since January."""
    return "instant" if table == "balance_sheet" else "duration"


FACT = (
    "fact_key string, stock_code string, period string, report_year int, period_ord int, statement_scope string, period_type string, metric string, "
    "table_name string, raw_value string, normalized_value decimal(24,4), source_unit string, target_unit string, source_file string, source_key string, "
    "page_no int, row_label string, column_label string, confidence double, validation_status string, review_version int, "
    "validation_issues array<struct<code:string,message:string,field:string>>"
)
SOURCE = "source_key string, source_file string, content_sha256 string, stock_code string, period string, source_owner string, authority_status string, current_slot string"
COMPANY = "stock_code string, stock_abbr string, company_name string, industry string"
