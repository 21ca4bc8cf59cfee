"""Table schemas, enumerations and business defaults."""

from pyspark.sql import types as T

# Enumerations, the tier price list and the status mappings.
ITEM_STATUSES = (
    "Arrived at Transit Warehouse",
    "Shipped to Ghana",
    "Arrived in Ghana",
    "Sorting",
    "Ready for Pickup",
    "Completed",
)
CONTAINER_STATUSES = ("Loading", "Shipped to Ghana", "Arrived in Ghana")
ORDER_STATUSES = ("Pending", "Partial", "Paid")
CUSTOMER_STATUSES = ("active", "inactive")
TIERS = ("basic", "business", "enterprise", "special")
ROLES = ("super_admin", "warehouse_staff", "customer")
SHIPPING_TYPES = ("air", "sea")
DIMENSION_UNITS = ("cm", "inches")
LEGACY_TIERS = {"standard": "basic", "discounted": "business", "premium": "enterprise"}
DEFAULT_RATES = (
    ("basic", 350.0, 8.0),
    ("business", 280.0, 6.0),
    ("enterprise", 450.0, 12.0),
    ("special", 500.0, 15.0),
)
ITEM_STATUS_FOR_CONTAINER = {
    "Shipped to Ghana": "Shipped to Ghana",
    "Arrived in Ghana": "Sorting",
}
CUBIC_INCH_CM3 = 16.387064
DEFAULT_DIAL_CODE = "+233"

RECEIVED, SHIPPED, ARRIVED, SORTING, READY, COMPLETED = ITEM_STATUSES
# Reaching any of these means the parcel has been seen again.
CLEARS_MISSING = (ARRIVED, SORTING, READY, COMPLETED)
UNPAID = ("Pending", "Partial")

MONEY = T.DecimalType(18, 2)
_TYPES = {
    "s": T.StringType(),
    "d": T.DoubleType(),
    "i": T.IntegerType(),
    "l": T.LongType(),
    "b": T.BooleanType(),
    "m": MONEY,
    "t": T.TimestampNTZType(),
    "ids": T.ArrayType(T.StringType()),
}


def _table(**columns):
    fields = [
        T.StructField(name, _TYPES[kind] if isinstance(kind, str) else kind)
        for name, kind in columns.items()
    ]
    return T.StructType(fields)


_THUMBNAIL = _table(url="s", width="i", height="i")
PHOTO = _table(
    id="s", url="s", filename="s", size="l", type="s",
    thumbnails=_table(small=_THUMBNAIL, large=_THUMBNAIL, full=_THUMBNAIL),
)
MESSAGE = _table(
    id="s", sender="s", senderName="s", content="s", timestamp="s",
    type="s", fileUrl="s", fileName="s", fileSize="l", mimeType="s",
)

CUSTOMERS = _table(
    id="s", name="s", phone="s", email="s", shipping_address="s", shipping_mark="s",
    login_uid="s", status="s", shipping_type="s", package="s", exchange_rate="d",
    notes="s", preferred_warehouse_id="s", created_at="t",
)
ITEMS = _table(
    id="s", item_ref="s", customer_id="s", customer_name="s", customer_shipping_mark="s",
    order_id="s", order_ref="s", container_id="s", container_name="s", status="s",
    is_missing="b", shipping_type="s", weight="d", length="d", width="d", height="d",
    dimension_unit="s", quantity="i", description="s", tracking_number="s",
    date_received="t", est_price="m", est_shipping_price="m", pkg_est_shipping="m",
    pkg_shipping_rate="d", special_shipping_rate="d", is_special_item="b",
    special_rate_name="s", notes="s", created_at="t", created_by="s",
    photos=T.ArrayType(PHOTO),
)
ORDERS = _table(
    id="s", order_ref="s", customer_id="s", customer_name="s", item_ids="ids",
    invoice_amount="m", discount="m", status="s", invoice_date="t", notes="s",
    created_at="t", sale_id="s", sale_link="s", amount_paid="m", balance_due="m",
)
CONTAINERS = _table(
    id="s", container_ref="s", name="s", description="s", status="s", item_ids="ids",
    eta="t", arrival_date="t", tracking_number="s", notes="s", created_at="t", created_by="s",
)
STATUS_HISTORY = _table(
    id="s", record_type="s", record_id="s", record_ref="s", previous_status="s",
    new_status="s", changed_by="s", changed_by_role="s", changed_at="t", notes="s",
)
ACTIVITY_LOGS = _table(
    id="s", action="s", user_email="s", user_role="s", details="s", entity_type="s",
    entity_id="s", timestamp="t", ip_address="s",
)
USERS = _table(
    id="s", login_uid="s", email="s", role="s", customer_id="s", customer_name="s",
    created_at="t", last_login="t",
)
SUPPLIERS = _table(
    id="s", supplier_ref="s", name="s", category="s", platform="s", platform_link="s",
    contact="s", contact_method="s", rating="i", notes="s", created_at="t", created_by="s",
)
WAREHOUSES = _table(
    id="s", name="s", address="s", country="s", phone="s", is_active="b", created_at="t",
)
REGISTRATIONS = _table(
    id="s", name="s", phone="s", phone2="s", email="s", existing_mark="s", location="s",
    status="s", submitted_at="t", notes="s",
)
SPECIAL_RATES = _table(id="s", name="s", sea="d", air="d")
PACKAGE_RATES = _table(id="s", tier="s", sea="d", air="d")
SETTINGS = _table(id="s", usd_to_local="d", rate_per_cbm="d")
TICKETS = _table(
    id="s", ticket_ref="s", customer_id="s", subject="s", status="s", messages="s",
    created_at="t", updated_at="t",
)

TABLES = {
    "customers": CUSTOMERS, "items": ITEMS, "orders": ORDERS, "containers": CONTAINERS,
    "status_history": STATUS_HISTORY, "activity_logs": ACTIVITY_LOGS, "users": USERS,
    "suppliers": SUPPLIERS, "warehouses": WAREHOUSES, "registrations": REGISTRATIONS,
    "special_rates": SPECIAL_RATES, "package_rates": PACKAGE_RATES, "settings": SETTINGS,
    "tickets": TICKETS,
}
