"""Column schemas, domain values and report labels."""

from pyspark.sql import types as T

MONEY = T.DecimalType(15, 2)


_TYPES = {
    "bigint": T.LongType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "decimal(15,2)": MONEY,
    "double": T.DoubleType(),
    "int": T.IntegerType(),
    "string": T.StringType(),
    "timestamp_ntz": T.TimestampNTZType(),
}


def _schema(**columns: str) -> T.StructType:
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in columns.items()])


# ---- upload files, checked by name --------------------------------------------------

TRIAL_BALANCE_FILE = _schema(
    company_code="string",
    period_code="string",
    account_code="string",
    account_name="string",
    tb_amount="decimal(15,2)",
)
INTERCO_FILE = _schema(
    company_code="string",
    period_code="string",
    rpt_interco_code="string",
    account_code="string",
    account_name="string",
    rpt_amount="decimal(15,2)",
)
COA_FILE = _schema(
    company_code="string",
    account_code="string",
    account_name="string",
    fs_group="bigint",
    wk_group_row="string",
)
FS_GROUP_FILE = _schema(
    company_code="string",
    wk_group_row="string",
    wk_group_name="string",
    fs_group_row="string",
    fs_group_name="string",
    account_type="string",
    account_subtype="string",
)

# ---- stored tables ------------------------------------------------------------------

TABLES = {
    "company": _schema(
        company_id="bigint",
        company_code="string",
        company_name="string",
        company_type="string",
        parent_company="string",
        company_est_date="date",
        country="string",
        currency="string",
        consolidation_rate="double",
        company_start_date="date",
        company_end_date="date",
    ),
    "period": _schema(
        company_code="string",
        period_code="string",
        period_description="string",
        period_date_from="date",
        period_date_to="date",
        period_status="string",
    ),
    "coa": COA_FILE,
    "fs_group": T.StructType([T.StructField("fs_group_id", T.LongType()), *FS_GROUP_FILE.fields]),
    "trial_balance": _schema(
        company_code="string",
        period_code="string",
        account_code="string",
        tb_amount="decimal(15,2)",
        tb_date_create="timestamp_ntz",
        tb_file_name="string",
    ),
    "interco": _schema(
        company_code="string",
        period_code="string",
        rpt_interco_code="string",
        account_code="string",
        rpt_amount="decimal(15,2)",
        rpt_date_create="timestamp_ntz",
        rpt_file_name="string",
    ),
    "journal_header": _schema(
        journal_no="string",
        period_code="string",
        parent_company_code="string",
        company_code="string",
        journal_type="string",
        journal_description="string",
    ),
    "journal_line": _schema(
        journal_no="string",
        period_code="string",
        company_code="string",
        rpt_interco_code="string",
        account_code="string",
        account_name="string",
        debit="decimal(15,2)",
        credit="decimal(15,2)",
        journal_amount="decimal(15,2)",
    ),
    "plan": _schema(plan_code="string", plan_description="string", plan_price="double"),
    "subscription": _schema(
        company_code="string", plan_code="string", start_date="date", end_date="date"
    ),
    "user": _schema(
        user_id="bigint",
        username="string",
        email="string",
        first_name="string",
        last_name="string",
        company_id="bigint",
        is_superuser="boolean",
        is_staff="boolean",
        is_active="boolean",
        date_joined="timestamp_ntz",
        last_login="timestamp_ntz",
    ),
    "group": _schema(group_id="int", group_name="string"),
    "user_group": _schema(user_id="bigint", group_id="int"),
    "content_type": _schema(content_type_id="int", app_label="string", model="string"),
    "admin_log": _schema(
        id="bigint",
        action_time="timestamp_ntz",
        user_id="bigint",
        content_type_id="int",
        object_id="string",
        object_repr="string",
        action_flag="int",
        change_message="string",
    ),
}

# Sums kept of the facts by account, and the highest number given to a journal of each parent.
ACCOUNT_FACT = T.StructType(
    [
        *_schema(
            company_code="string", period_code="string", account_code="string", source="string"
        ).fields,
        T.StructField("amount", T.DecimalType(25, 2)),
    ]
)
JOURNAL_MARKS = _schema(parent_company_code="string", period_code="string", last_number="bigint")

# Longest text each column may hold (fixed values of the data model).
MAX_LENGTHS = {
    "company_code": 5,
    "company_name": 100,
    "company_type": 100,
    "parent_company": 5,
    "country": 100,
    "currency": 3,
    "period_code": 7,
    "period_description": 100,
    "account_code": 15,
    "account_name": 255,
    "wk_group_row": 10,
    "wk_group_name": 255,
    "fs_group_row": 10,
    "fs_group_name": 255,
    "rpt_interco_code": 5,
    "journal_no": 15,
    "journal_description": 1000,
    "plan_code": 5,
    "plan_description": 100,
    "tb_file_name": 255,
    "rpt_file_name": 255,
}

# ---- fixed domain values ------------------------------------------------------------

ASSET = "สินทรัพย์"
LIABILITY = "หนี้สิน"
CURRENT_ASSET = "สินทรัพย์หมุนเวียน"
OTHER_ASSET = "สินทรัพย์ไม่หมุนเวียน"
CURRENT_LIABILITY = "หนี้สินหมุนเวียน"
OTHER_LIABILITY = "หนี้สินไม่หมุนเวียน"
EQUITY = "ส่วนของผู้ถือหุ้น"
REVENUE = "รายได้"
EXPENSE = "ค่าใช้จ่าย"
UNMAPPED = "n/a group"

ACCOUNT_TYPES = (ASSET, LIABILITY, EQUITY, REVENUE, EXPENSE)
ACCOUNT_SUBTYPES = (
    "สินทรัพย์",
    "สินทรัพย์หมุนเวียน",
    "สินทรัพย์ไม่หมุนเวียน",
    "หนี้สิน",
    "หนี้สินหมุนเวียน",
    "หนี้สินไม่หมุนเวียน",
    "ส่วนของผู้ถือหุ้น",
    "ทุนเรือนหุ้น",
    "ทุนจดทะเบียน",
    "ทุนที่ออกและชำระแล้ว",
    "ส่วนเกิน (ต่ำกว่า) มูลค่าหุ้น",
    "กำไร (ขาดทุน) สะสม",
    "กำไร (ขาดทุน) สะสม-จัดสรรแล้ว",
    "หุ้นกู้ที่มีลักษณะคล้ายทุน",
    "รายได้",
    "ต้นทุน",
    "ค่าใช้จ่าย",
    "กำไร (ขาดทุน) เบ็ดเสร็จอื่น",
)
STATEMENTS = {
    "bs": (ASSET, LIABILITY, EQUITY, UNMAPPED),
    "pl": (REVENUE, EXPENSE),
}
PERIOD_STATUSES = ("Open", "Closed", "Never Open")
COMPANY_TYPES = ("Parent", "Subsidiary", "Associate", "Investment")
RECLASSIFY = "Reclassify"
TAKE_EQUITY = "TakeEq"

# Characters of an uploaded file name that become an underscore (fixed values).
FILE_NAME_PUNCTUATION = "!@#$%^&*'()[]{};:,/<>?\\|`~=+"

# ---- fixed report labels ------------------------------------------------------------

LABELS = {
    "rpt_result": {
        "account_type": "Account type",
        "account_subtype": "Account subtype",
        "wk_group_row": "WK group row",
        "wk_group_name": "WK group name",
        "rpt_interco_code": "Interco code",
        "total_rpt": "Total RPT",
    },
    "working": {
        "account_type": "Account type",
        "account_subtype": "Account subtype",
        "wk_group_row": "WK group row",
        "wk_group_name": "WK group name",
        "total_separate": "Total Separate",
        "eliminate": "Eliminate",
        "take_equity": "Take equity",
        "total_conso": "Total Conso",
    },
    "report": {
        "account_type": "Account type",
        "account_subtype": "Account subtype",
        "fs_group_row": "FS group row",
        "fs_group_name": "FS group name",
        "separate_fs": "Separate FS",
        "consolidated_fs": "Consolidated FS",
    },
    "subscription": {
        "company_code": "Company code",
        "company_name": "Company name",
        "plan_code": "Plan code",
        "plan_description": "Plan Description",
        "plan_price": "Plan price",
        "start_date": "Start date",
        "end_date": "End date",
    },
    "company_member": {
        "parent_company": "Parent company code",
        "parent_company_name": "Parent company name",
        "company_code": "Company code",
        "company_name": "Company name",
        "company_type": "company type",
        "country": "Country",
        "currency": "Currency",
        "company_est_date": "Established date",
        "company_start_date": "Start date",
        "company_end_date": "End date",
        "company_count": "Company count",
    },
    "user": {
        "username": "Username",
        "first_name": "First name",
        "last_name": "Last name",
        "company_code": "Company code",
        "company_name": "Company name",
        "group_name": "Group name",
        "is_superuser": "Superuser",
        "is_staff": "Staff",
        "is_active": "Active",
        "date_joined": "Date joined",
        "last_login": "Last login",
    },
    "admin_log": {
        "content_type_id": "Content type id",
        "app_label": "App label",
        "model": "Model",
        "object_id": "Object id",
        "object_repr": "Object repr",
        "action_flag": "Action flag",
        "change_message": "Change message",
        "user_id": "User id",
        "username": "Username",
        "first_name": "First name",
        "last_name": "Last name",
        "action_date": "Action date",
        "action_time": "Action time",
    },
}
