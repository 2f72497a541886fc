"""Field names and keys that the data uses, and columns that look values up by them."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Standard fields and their labels, by data type.
COMMON_FIELDS = {"employee_name": "员工姓名", "employee_id": "工号", "department": "部门", "record_date": "业务日期"}
TYPE_FIELDS = {
    "attendance": {"attendance_days": "出勤天数", "leave_days": "请假天数", "overtime_hours": "加班时长(小时)", "late_count": "迟到次数"},
    "sales": {"order_amount": "订单金额", "order_count": "订单数量", "product_name": "产品名称", "customer_name": "客户名称", "payment_method": "支付方式"},
    "customer": {"customer_name": "客户名称", "customer_level": "客户等级", "contract_amount": "合同金额", "contact_phone": "联系电话", "follow_up_date": "最后跟进日期"},
    "operation": {"metric_name": "指标名称", "metric_value": "指标数值", "metric_unit": "指标单位", "target_value": "目标值", "completion_rate": "完成率"},
}
# Payload keys in the order in which lookups and reports try them.
LOOKUP_DEPARTMENT_KEYS = ("department", "所属部门", "部门", "Dept")
LOOKUP_NAME_KEYS = ("employee_name", "姓名", "销售员", "Name")
LOOKUP_DATE_KEYS = ("record_date", "考勤日期", "日期", "Date")
REPORT_DATE_KEYS = ("考勤日期", "销售日期", "交易日期", "记录日期", "日期", "date", "Date", "DATE", "record_date", "业务日期")
REPORT_DEPARTMENT_KEYS = ("所属部门", "部门", "department", "Department", "dept", "Dept")
UNKNOWN_DEPARTMENT = "未知部门"


def payload(key: str) -> Column:
    return F.col("business_data").getItem(key)


def first_text(column: str, keys: tuple[str, ...], default: str, trim: bool = False) -> Column:
    """The column, else the first payload key that holds text, else the default."""
    clean = (lambda c: F.nullif(F.trim(c), F.lit(""))) if trim else (lambda c: F.nullif(c, F.lit("")))
    return F.coalesce(F.nullif(F.col(column), F.lit("")), *(clean(payload(k)) for k in keys), F.lit(default))


def lookup_department() -> Column:
    return first_text("department", LOOKUP_DEPARTMENT_KEYS, "")


def report_department() -> Column:
    return first_text("department", REPORT_DEPARTMENT_KEYS, UNKNOWN_DEPARTMENT, trim=True)


def record_name() -> Column:
    return first_text("employee_name", LOOKUP_NAME_KEYS, "")


def lookup_date() -> Column:
    """ISO text; payload dates with their separators made alike."""
    return F.coalesce(F.date_format("record_date", "yyyy-MM-dd"), *(F.nullif(F.replace(payload(k), F.lit("/"), F.lit("-")), F.lit("")) for k in LOOKUP_DATE_KEYS), F.lit(""))


def report_date() -> Column:
    """A date; a key whose value cannot be parsed gives way to the next."""
    return F.coalesce("record_date", *(F.try_to_date(F.substring(F.trim(F.replace(payload(k), F.lit("/"), F.lit("-"))), 1, 10), "yyyy-MM-dd") for k in REPORT_DATE_KEYS))


def quality() -> Column:
    """The score, with null and 0 counted as 1."""
    return F.coalesce(F.nullif("quality_score", F.lit(0.0)), F.lit(1.0))


def percent(part: Column, whole: Column, digits: int = 2) -> Column:
    return F.when(whole > 0, F.round(part * 100.0 / whole, digits)).otherwise(0.0)
