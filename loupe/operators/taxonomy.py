"""Issues of each domain: issue, label, severity and the words that name it; a table of the same form may take their place."""

from __future__ import annotations

# The issues of the four domains in their order, and the words and phrases that name a problem of any kind.
MOBILE_APP = [
    ("crash", "Crash / App Failure", 25, ["crash", "crashes", "crashed", "freezes", "frozen", "force close", "stops working", "not open", "won't open", "doesn't open", "unusable"]),
    ("login", "Login / Account Access", 20, ["login", "log in", "sign in", "password", "otp", "verification", "account", "authentication", "cannot access", "can't access"]),
    ("payment", "Payment / Billing", 25, ["payment", "paid", "charged", "billing", "transaction", "money deducted", "purchase", "refund", "card", "bank"]),
    ("privacy", "Privacy / Data Concern", 25, ["privacy", "permission", "permissions", "tracking", "data", "location", "contacts", "personal information", "security"]),
    ("subscription", "Subscription / Cancellation", 18, ["subscription", "subscribe", "premium", "renewal", "cancel", "cancelled", "auto renewal", "trial"]),
    ("advertising", "Advertisements / Popups", 12, ["ad", "ads", "advertisement", "advertisements", "popup", "pop up", "pop-up", "commercial"]),
    ("inappropriate_content", "Inappropriate / Explicit Content", 25, ["sex", "sex content", "sexy", "sexy pictures", "sexual", "sexual content", "explicit", "explicit content", "adult", "adult content", "adult material",
        "inappropriate", "inappropriate content", "inappropriate pictures", "shameful", "shamefull", "shameful pictures", "shamefull pictures", "obscene", "porn", "pornographic", "nude", "nudity", "naked", "naked pictures"]),
    ("performance", "Performance / Speed", 15, ["slow", "lag", "laggy", "loading", "performance", "delay", "delayed", "unresponsive", "hang"]),
]
HOTEL = [
    ("cleanliness", "Cleanliness", 25, ["dirty", "unclean", "smell", "smelly", "bathroom", "toilet", "dust", "mold", "mould", "stain", "stains", "hygiene", "cleanliness"]),
    ("room_quality", "Room Quality", 18, ["room", "bed", "air condition", "air conditioning", "ac", "broken", "small", "hot", "cold", "old", "maintenance", "shower"]),
    ("staff_service", "Staff / Service", 18, ["staff", "service", "rude", "unhelpful", "reception", "manager", "customer service", "front desk", "attitude"]),
    ("noise", "Noise", 12, ["noise", "noisy", "loud", "sound", "traffic", "music", "disturb", "disturbed", "soundproof"]),
    ("booking", "Booking / Check-in", 15, ["booking", "reservation", "check in", "check-in", "checkout", "check out", "cancel", "cancelled", "room not ready"]),
    ("wifi", "Wi-Fi / Internet", 10, ["wifi", "wi-fi", "internet", "connection", "network", "signal"]),
]
ECOMMERCE = [
    ("delivery", "Delivery / Shipping", 15, ["delivery", "delivered", "shipping", "shipment", "late", "arrived", "courier", "tracking", "not received"]),
    ("refund", "Refund / Return", 22, ["refund", "return", "returned", "money back", "replacement", "exchange", "can't return", "cannot return"]),
    ("fake_product", "Fake / Counterfeit Product", 25, ["fake", "counterfeit", "not original", "duplicate", "not genuine", "knockoff", "copy"]),
    ("damaged_item", "Damaged / Broken Item", 20, ["damaged", "broken", "cracked", "leaked", "leaking", "defective", "faulty", "spill", "spilled"]),
    ("packaging", "Packaging", 10, ["package", "packaging", "box", "packed", "packing", "sealed", "seal"]),
    ("product_quality", "Product Quality", 18, ["quality", "poor", "cheap", "bad product", "not as described", "doesn't work", "does not work", "useless"]),
]
RESTAURANT = [
    ("food_quality", "Food Quality", 18, ["food", "taste", "tasted", "cold", "stale", "fresh", "meal", "dish", "flavour", "flavor", "overcooked", "undercooked"]),
    ("hygiene", "Hygiene / Cleanliness", 25, ["dirty", "hygiene", "clean", "unclean", "hair", "table", "toilet", "bathroom", "smell"]),
    ("staff_service", "Staff / Service", 18, ["staff", "service", "rude", "waiter", "server", "manager", "customer service", "attitude"]),
    ("wait_time", "Waiting Time", 12, ["wait", "waiting", "slow", "delay", "delayed", "took long", "long time", "queue"]),
    ("price_value", "Price / Value", 10, ["price", "expensive", "overpriced", "value", "money", "worth", "cost", "costly"]),
    ("ambience", "Ambience / Atmosphere", 8, ["ambience", "ambiance", "atmosphere", "music", "place", "seating", "environment", "decor"]),
]
PROBLEM_CUES = [
    "bad", "poor", "terrible", "awful", "worst", "horrible", "issue", "problem", "problems", "complaint", "complaints", "failed", "failure", "not working", "doesn't work", "does not work",
    "dirty", "broken", "damaged", "refund", "return", "crash", "crashes", "rude", "slow", "delay", "delayed", "fake", "charged", "payment", "privacy", "unable", "cannot", "can't", "won't",
    "disappointed", "waste", "useless", "leaked", "leaking", "stale", "cold", "overpriced", "unhelpful", "missing", "cancel", "cancelled",
    "sex content", "sexy", "sexual", "sexual content", "explicit", "explicit content", "adult content", "adult material", "inappropriate", "inappropriate content",
    "shameful", "shamefull", "obscene", "porn", "pornographic", "nude", "nudity", "naked", "naked pictures",
]

TABLES = {"mobile_app": MOBILE_APP, "hotel": HOTEL, "ecommerce": ECOMMERCE, "restaurant": RESTAURANT}
#: (domain, issue, label, severity, ord, keywords); ord: the place in the order of all.
ROWS = [(d, i, label, s, n, k) for n, (d, (i, label, s, k)) in enumerate((d, row) for d, rows in TABLES.items() for row in rows)]
