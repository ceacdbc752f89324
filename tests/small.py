"""Small hand-made tables."""

from decimal import Decimal

from ledgerfold.schemas import ASSET, EQUITY, EXPENSE, LIABILITY, REVENUE
from ledgerfold.sources.books import Books

D = Decimal

COMPANY = "company_code string, company_name string, company_type string, parent_company string"
PERIOD = "company_code string, period_code string, period_status string"
COA = "company_code string, account_code string, account_name string, fs_group bigint, wk_group_row string"
FS_GROUP = (
    "fs_group_id bigint, company_code string, wk_group_row string, wk_group_name string,"
    " fs_group_row string, fs_group_name string, account_type string, account_subtype string"
)
TB = "company_code string, period_code string, account_code string, tb_amount decimal(15,2), tb_file_name string"
INTERCO = (
    "company_code string, period_code string, rpt_interco_code string, account_code string,"
    " rpt_amount decimal(15,2), rpt_file_name string"
)
HEADER = (
    "journal_no string, period_code string, parent_company_code string, company_code string,"
    " journal_type string"
)
LINE = "journal_no string, account_code string, debit decimal(15,2), credit decimal(15,2)"


def group_of_two(spark, **changes):
    """Parent P and subsidiary S; accounts 0100 and 0200 share working group W1."""
    make = spark.createDataFrame
    tables = {
        "company": make(
            [("P", "Parent Co", "Parent", "P"), ("S", "Sub Co", "Subsidiary", "P"), ("X", "Other", "Parent", "X")],
            COMPANY,
        ),
        "period": make([("P", "Q1_2024", "Open"), ("P", "Q4_2023", "Closed")], PERIOD),
        "coa": make(
            [
                (c, a, n, g, w)
                for c in ("P", "S", "X")
                for a, n, g, w in (
                    ("0100", "Cash", 1, "W1"),
                    ("0200", "Bank", 1, "W1"),
                    ("0300", "Loans", 2, "W2"),
                    ("0400", "Capital", 3, "W3"),
                    ("0500", "Sales", 4, "W4"),
                    ("0600", "Cost", 5, "W5"),
                )
            ],
            COA,
        ),
        "fs_group": make(
            [
                (1, "P", "W1", "Liquid", "F1", "Current assets", ASSET, ASSET),
                (2, "P", "W2", "Debt", "F2", "Debt", LIABILITY, LIABILITY),
                (3, "P", "W3", "Capital", "F3", "Equity", EQUITY, EQUITY),
                (4, "P", "W4", "Sales", "F4", "Income", REVENUE, REVENUE),
                (5, "P", "W5", "Cost", "F5", "Cost", EXPENSE, EXPENSE),
            ],
            FS_GROUP,
        ),
        "trial_balance": make(
            [
                ("P", "Q1_2024", "0100", D("100.00"), "p.csv"),
                ("P", "Q1_2024", "0300", D("-60.00"), "p.csv"),
                ("P", "Q1_2024", "0500", D("-40.00"), "p.csv"),
                ("S", "Q1_2024", "0200", D("30.00"), "s.csv"),
                ("S", "Q1_2024", "0400", D("-30.00"), "s.csv"),
                ("S", "Q4_2023", "0200", D("7.00"), "old.csv"),
                ("X", "Q1_2024", "0100", D("999.00"), "x.csv"),
            ],
            TB,
        ),
        "interco": make([("S", "Q1_2024", "P", "0300", D("5.00"), "r.csv")], INTERCO),
        "journal_header": make(
            [
                ("P_JV_00001", "Q1_2024", "P", "P", "Reclassify"),
                ("P_JV_00002", "Q1_2024", "P", "S", "TakeEq"),
            ],
            HEADER,
        ),
        "journal_line": make(
            [
                ("P_JV_00001", "0100", D("10.00"), None),
                ("P_JV_00001", "0200", D("10.00"), None),
                ("P_JV_00001", "0300", None, D("20.00")),
                ("P_JV_00002", "0200", D("3.00"), None),
                ("P_JV_00002", "0400", None, D("3.00")),
            ],
            LINE,
        ),
    }
    return Books(**{**tables, **changes})


def rows(df, *columns):
    return sorted(
        (tuple(r[c] for c in (columns or df.columns)) for r in df.collect()),
        key=lambda t: tuple(str(v) for v in t),
    )
