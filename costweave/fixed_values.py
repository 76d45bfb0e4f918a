"""Constants that must be exactly these for results to be right."""

# --- Fixed values: units and price year -----------------------------------
KM_PER_MILE = 1.60934
PRICE_YEAR = 2021

# --- Fixed values: project table ------------------------------------------
# raw header -> clean name, in output order
PROJECT_COLUMNS = {
    "Country": "country",
    "City": "city",
    "Line": "line",
    "Phase": "phase",
    "Start year": "start_year",
    "End year": "end_year",
    "RR?": "is_regional_rail",
    "Length": "length_km",
    "TunnelPer": "tunnel_pct",
    "Tunnel": "tunnel_km",
    "Stations": "num_stations",
    "Anglo?": "is_anglo",
    "PPP rate": "ppp_rate",
    "Real cost (2023 dollars)": "real_cost_2023_musd",
    "Cost/km (2023 dollars)": "cost_per_km_2023_musd",
}
# cells that may hold several numbers separated by slashes
SLASH_NUMBER_COLUMNS = ["num_stations"]
PLAIN_NUMBER_COLUMNS = [
    "start_year", "end_year", "length_km", "tunnel_pct", "tunnel_km", "ppp_rate",
    "is_regional_rail", "cost_per_km_2023_musd",
]
TARGET = "cost_per_km_2023_musd"
OUTLIER_LINES = ["Capital Airport Express", "Tozai Line (Sendai)"]

# --- Fixed values: subsystem cost table (clean names) ---------------------
# headers the general renaming rule would get wrong
SUBSYSTEM_HEADER_EXCEPTIONS = {
    "project_all_costs_have_been_adjusted_for_inflation_in_2021_dollars": "project",
    "mode_1": "mode_full",
    "loccity": "city",
    "length": "length_miles",
    "at_grade": "at_grade_miles",
    "above_grade": "elevated_miles",
    "below_grade": "below_grade_miles",
    "soft_hard_percent": "soft_hard_pct",
}
DOLLAR_COLUMNS = [
    "project_cost", "cost_per_mile", "hard_costs_row", "hard_costs", "soft_costs",
    "avg_cost_per_vehicle", "avg_cost_per_station", "vehicle_costs", "row_costs",
    "systems_costs", "sitework_costs", "facilities_costs", "station_costs", "guideway_costs",
    "soft_costs_per_mile", "row_costs_per_mile", "system_costs_per_mile",
    "sitework_costs_per_mile", "facility_costs_per_mile", "guideway_costs_per_mile",
]
SHARE_CHECK_COLUMNS = [
    "tunnel_pct", "soft_hard_pct", "soft_costs_pct", "vehicle_costs_pct", "row_costs_pct",
    "systems_costs_pct", "sitework_costs_pct", "facilities_costs_pct", "station_costs_pct",
    "guideway_costs_pct",
]
MILE_LENGTHS = {
    "length_miles": "length_km",
    "at_grade_miles": "at_grade_km",
    "elevated_miles": "elevated_km",
    "below_grade_miles": "below_grade_km",
    "tunnel_miles": "tunnel_km",
}
PER_MILE_COSTS = {
    "cost_per_mile": "cost_per_km",
    "soft_costs_per_mile": "soft_costs_per_km",
    "row_costs_per_mile": "row_costs_per_km",
    "system_costs_per_mile": "system_costs_per_km",
    "sitework_costs_per_mile": "sitework_costs_per_km",
    "facility_costs_per_mile": "facility_costs_per_km",
    "guideway_costs_per_mile": "guideway_costs_per_km",
}
TOTALS_PER_KM = {
    "vehicle_costs": "vehicle_costs_per_km",
    "row_costs": "row_costs_per_km_direct",
    "systems_costs": "systems_costs_per_km",
    "sitework_costs": "sitework_costs_per_km_direct",
    "facilities_costs": "facilities_costs_per_km",
    "station_costs": "station_costs_per_km",
    "guideway_costs": "guideway_costs_per_km_direct",
    "soft_costs": "soft_costs_per_km_direct",
    "hard_costs": "hard_costs_per_km",
}
# share column -> subsystem label, in display order
SUBSYSTEM_SHARES = {
    "guideway_costs_pct": "Guideway",
    "station_costs_pct": "Stations",
    "systems_costs_pct": "Systems",
    "soft_costs_pct": "Soft Costs",
    "vehicle_costs_pct": "Vehicles",
    "row_costs_pct": "Right-of-Way (ROW)",
    "sitework_costs_pct": "Sitework",
    "facilities_costs_pct": "Facilities",
}
DEFAULT_RATIOS = {
    "Guideway": 0.32,
    "Stations": 0.20,
    "Systems": 0.16,
    "Soft Costs": 0.14,
    "Vehicles": 0.08,
    "Right-of-Way (ROW)": 0.05,
    "Sitework": 0.03,
    "Facilities": 0.02,
}
TRANSIT_MODES = ["HRT", "LRT", "BRT", "CRT"]
DEFAULT_MODE = "HRT"
FORCED_GLOBAL_MODES = ["Trolley"]
SMALL_SAMPLE = 5

# --- Fixed values: model features -----------------------------------------
# feature -> display name, in model input order
FEATURES = {
    "country_te": "National Premium",
    "country_freq": "National Market Size",
    "city_te": "Local Premium",
    "city_freq": "Local Market Size",
    "tunnel_pct": "Tunnel Proportion",
    "station_density": "Station Density",
    "log_length": "Line Length (log)",
    "is_regional_rail": "Is Regional Rail?",
    "mid_year": "Inflation (Mid-Year)",
}
ENCODER_SMOOTHING = 10.0
COUNTRY_SMOOTHING = 20.0
CITY_SMOOTHING = 30.0
LENGTH_OFFSET = 0.1

# --- Fixed values: training and calibration -------------------------------
FOLDS = 5
SEED = 42
COST_BINS = 5
TREES = 1200
LEARNING_RATE = 0.1
TREE_DEPTH = 3
SUBSAMPLE = 0.8
MIN_LEAF_ROWS = 5
ALPHA = 0.5
MIN_BAND_WIDTH = 0.05
SUCCESS_ERROR = 0.30
DEFAULT_Q10 = 0.65
DEFAULT_Q90 = 1.45
MIN_COUNTRY_ROWS = 3
MIN_MODE_ROWS = 2
MIN_DRIVER_SHARE = 0.01
DRIVER_UP = "Increases Cost (+)"
DRIVER_DOWN = "Decreases Cost (-)"

# --- Fixed values: similarity ---------------------------------------------
LOCATION_WEIGHT = 3.0
COUNTRY_WEIGHT = 1.5
LENGTH_SCALE = 1.0
TUNNEL_SCALE = 3.0
LENGTH_CLAMP = 0.5
MAX_SIMILARITY = 6.5
SIMILAR_PROJECTS = 8

# --- Fixed values: country code -> name -----------------------------------
COUNTRY_NAMES = {
    "AE": "United Arab Emirates", "AR": "Argentina", "AT": "Austria",
    "AU": "Australia", "BD": "Bangladesh", "BE": "Belgium",
    "BG": "Bulgaria", "BH": "Bahrain", "BR": "Brazil",
    "CA": "Canada", "CH": "Switzerland", "CL": "Chile",
    "CN": "China", "CO": "Colombia", "CZ": "Czech Republic",
    "DE": "Germany", "DK": "Denmark", "DR": "Dominican Republic",
    "EC": "Ecuador", "EG": "Egypt", "ES": "Spain",
    "FI": "Finland", "FR": "France", "GR": "Greece",
    "HK": "Hong Kong", "HU": "Hungary", "ID": "Indonesia",
    "IL": "Israel", "IN": "India", "IR": "Iran",
    "IT": "Italy", "JP": "Japan", "KR": "South Korea",
    "KW": "Kuwait", "MX": "Mexico", "MY": "Malaysia",
    "NL": "Netherlands", "NO": "Norway", "NZ": "New Zealand",
    "PA": "Panama", "PE": "Peru", "PH": "Philippines",
    "PK": "Pakistan", "PL": "Poland", "PT": "Portugal",
    "QA": "Qatar", "RO": "Romania", "RS": "Serbia",
    "RU": "Russia", "SA": "Saudi Arabia", "SE": "Sweden",
    "SG": "Singapore", "TH": "Thailand", "TR": "Turkey",
    "TW": "Taiwan", "UA": "Ukraine", "UK": "United Kingdom",
    "US": "United States", "UZ": "Uzbekistan", "VN": "Vietnam",
}
