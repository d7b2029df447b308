"""Parameters the registered queries use on the driver's tables (FIXTURES.md §2)."""

# Fixed values chosen for the star-schema binding.
BASKET_KEYS = ["branch", "order_id"]         # order baskets (branch rides along with the order)
BASKET_ITEM = "grp"                          # 25 brands
LIFETIME_KEYS = ["branch", "customer"]       # the reference's basket: a customer's lifetime at a branch
LIFETIME_ITEM = "item"
MIN_SUPPORT = 0.014
MIN_CONFIDENCE = 0.11
ITEMSET_MIN_SUPPORT = 0.0006
ITEMSET_MIN_CONFIDENCE = 0.12
MOD_GROUPS = ["Brand#1", "Brand#2"]
MOD_PATTERNS = [r"^new\s", r"anvil$"]
CATEGORY_RULES = [("coffee", ["RING", "BOLT"]), ("milkshake", ["GEAR"]), ("frappe", ["GIZMO"])]
CATEGORY_DIVISIONS = ["PROMO", "ECONOMY"]
ATTENDANCE_MONTH = 1
TRIPLE_MIN_COUNT = 2
BRANCH_TOP_K = 10
