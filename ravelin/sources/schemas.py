"""Fixed schemas of the inputs; nothing is inferred."""

REVIEW = "user_id string, business_id string, stars double, date string, text string"
BUSINESS = "business_id string, categories string, state string, city string"
PAIR = "user_id string, business_id string"
CF_MODEL = "a string, b string, sim double"
EVENT_LINE = "value string"
