"""Fixed values as the SQL side states them.

Kept apart from the engine's lists on purpose: a wrong entry in the engine's own list must show
as a difference, and would not if both sides read the same list.
"""

MISSING_MARKERS = ["", "n/a", "na", "null", "none", "-", "--", "nan", "undefined", "?"]
ROLE_HINTS = {
    "date": ["date", "invoicedate", "orderdate", "created", "createdat", "timestamp",
             "time", "day", "period", "transactiondate", "purchasedate", "shipdate"],
    "identifier": ["id", "invoiceno", "invoice no", "orderid", "order id", "transactionid",
                   "reference", "ref no", "uuid", "code", "stockcode", "sku"],
    "product": ["product", "item", "description", "sku", "stockcode", "productname",
                "productcategory", "service", "itemname"],
    "customer": ["customer", "client", "buyer", "account", "user", "member", "subscriber",
                 "customerid", "clientid", "email", "contact"],
    "category": ["category", "segment", "type", "class", "group", "department", "tag",
                 "tier", "status"],
    "quantity": ["quantity", "qty", "units", "count", "volume", "stock", "orderqty",
                 "numberof", "no of"],
    "price": ["price", "unitprice", "rate", "cost per unit", "priceperunit", "listprice",
              "unit cost"],
    "cost": ["cost", "expense", "cogs", "costofgoods", "expenditure", "spend"],
    "revenue": ["revenue", "sales", "total amount", "totalamount", "amount", "total",
                "value", "linetotal", "extendedprice", "turnover", "income", "gmv"],
    "percentage": ["percent", "pct", "rate", "margin", "ratio", "discount"],
    "location": ["country", "region", "market", "location", "territory", "city", "state",
                 "postcode", "zip", "address"],
    "employee": ["employee", "staff", "agent", "rep", "salesperson", "manager", "hire"],
    "inventory": ["inventory", "stocklevel", "warehouse", "reorder", "onhand", "stock qty"],
    "duration": ["duration", "tenure", "length", "daysto", "timeto", "lifespan", "age"],
    "status": ["status", "state", "stage", "flag", "active", "churned", "cancelled"],
}
NUMERIC_ROLES = ["quantity", "price", "cost", "revenue", "percentage", "duration", "inventory"]
EMAIL = r"^[^\s@]+@[^\s@]+\.[^\s@]+$"
ISO_DAY = r"^\d{4}-\d{1,2}-\d{1,2}"
SLASH_DAY = r"^\d{1,2}[/.]\d{1,2}[/.]\d{2,4}$"
POSTCODE = r"(?i)^[A-Z]{1,2}\d[A-Z\d]?\s*\d[A-Z]{2}$"
ITEM_CODE = "^[A-Z0-9]{4,12}$"
DAY_MONTH_NAME = r"^\d{1,2}\s+[A-Za-z]{3,9}\s+\d{2,4}$"
MONTH_NAME_DAY = r"^[A-Za-z]{3,9}\s+\d{1,2},?\s+\d{2,4}$"
PADDED_ISO_DAY = r"^\d{4}-\d{2}-\d{2}"
PLAIN_NUMBER = r"^-?\d+(\.\d+)?$"
NUMBER_TEXT = r"^([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)$"
LEADING_NUMBER = r"^\s*([+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)"
WEEKDAYS = ["Sun", "Mon", "Tue", "Wed", "Thu", "Fri", "Sat"]
MONTHS = ["Jan", "Feb", "Mar", "Apr", "May", "Jun", "Jul", "Aug", "Sep", "Oct", "Nov", "Dec"]
SERIES_MEASURES = ["revenue", "price", "cost", "quantity", "percentage", "inventory", "duration"]
BREAKDOWN_MEASURES = ["revenue", "price", "quantity"]
PURPOSE_WORDS = [
    ("inventory", "stock|inventory|warehouse|sku balance"),
    ("customers", "customer|client|account|crm"),
    ("products", "product|catalog|item|sku"),
    ("finance", "expense|cost|finance|ledger|invoice"),
    ("sales", "sale|order|transaction|revenue"),
]
LINK_ROLES = ["identifier", "customer", "product", "date", "location"]
RETAIL_COLUMNS = {
    "amount": ["unitprice", "price per unit", "priceperunit", "price", "revenue",
               "total amount", "totalamount", "total", "amount", "sales", "value",
               "linetotal", "extendedprice"],
    "quantity": ["quantity", "qty", "units", "orderqty"],
    "date": ["invoicedate", "date", "orderdate", "created", "time", "timestamp"],
    "product": ["description", "product category", "productcategory", "product", "item",
                "name", "stockcode", "sku"],
    "market": ["country", "region", "market", "location", "territory"],
    "customer": ["customerid", "customer id", "customer", "client", "clientid", "userid",
                 "email"],
}
ORDER_VALUE_EDGES = [25, 50, 100, 200]
LIFETIME_VALUE_EDGES = [50, 200, 500, 1000]
