"""Column roles, domain names and the fixed values the results depend on."""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values (must equal the original tool's for the same results).
# Domain column names of the sales fact, in the original row order.
# ---------------------------------------------------------------------------
DATE = "Date"
COUNTRY = "Country"
CHANNEL = "Channel"
PRODUCT = "Product_Category"
VOLUME = "Net_Sales_Volume_Litres"
REVENUE = "Net_Sales_Revenue_EUR"
COGS = "COGS_EUR"
MARKETING = "Marketing_Spend_EUR"
PROMO = "Promotional_Event"
CONFIDENCE = "Consumer_Confidence_Index"
INFLATION = "Inflation_Rate_EUR"
TEMPERATURE = "Avg_Temp_C"
HOLIDAY = "Holiday_Indicator"
COMPETITOR = "Competitor_Activity_Index"

SEGMENT_KEYS = [COUNTRY, CHANNEL, PRODUCT]
DOMAIN_TARGETS = {"sales": REVENUE, "cogs": COGS, "volume": VOLUME}

# Feature order of the sales/COGS models (18) and the volume model (16).
SALES_FEATURES = [
    "Net_Sales_Volume_Litres", "Marketing_Spend_EUR", "Promotional_Event",
    "Consumer_Confidence_Index", "Inflation_Rate_EUR", "Avg_Temp_C",
    "Holiday_Indicator", "Competitor_Activity_Index",
    "day_of_week", "month", "year", "day_of_year", "week_of_year",
    "Net_Sales_Revenue_EUR_lag1", "COGS_EUR_lag1",
    "Country", "Channel", "Product_Category",
]
VOLUME_FEATURES = [
    "Marketing_Spend_EUR", "Promotional_Event",
    "Consumer_Confidence_Index", "Inflation_Rate_EUR", "Avg_Temp_C",
    "Holiday_Indicator", "Competitor_Activity_Index",
    "day_of_week", "month", "year", "day_of_year", "week_of_year",
    "Net_Sales_Volume_Litres_lag1",
    "Country", "Channel", "Product_Category",
]

# Holiday calendars as (month, day) pairs - forecast days, the
# sales history, the restaurant demo.
HOLIDAYS_FORECAST = [(12, 25)]
HOLIDAYS_SALES_DATA = [(1, 1), (12, 25), (4, 1), (4, 2), (4, 3)]
HOLIDAYS_RESTAURANT = [(12, 24), (12, 25), (12, 31)]

# Name keywords that mark a numeric column as a potential target.
TARGET_KEYWORDS = ["revenue", "sales", "profit", "volume", "amount", "value", "cost"]
# The generic calendar features, in order.
TIME_FEATURES = ["year", "month", "day", "day_of_week", "day_of_year",
                 "week_of_year", "quarter", "month_sin", "month_cos",
                 "day_sin", "day_cos"]
# Default lags of the generic engine; categorical cut-off.
DEFAULT_LAGS = [1, 7, 30]
CATEGORICAL_MAX_DISTINCT = 20

# Accuracy rating bands (MAPE <=, R2 >=) in order.
RATING_BANDS = [(5.0, 0.9, "EXCELLENT"), (10.0, 0.8, "GOOD"), (20.0, 0.6, "FAIR")]
RATING_FALLBACK = "NEEDS IMPROVEMENT"

# Recommendation texts (report variant), in order.
REC_SALES_MAPE = "Sales model MAPE > 15% - Consider feature engineering or hyperparameter tuning"
REC_COGS_MAPE = "COGS model MAPE > 15% - May need additional training data or model complexity"
REC_VOLUME_MAPE = ("Volume model MAPE > 15% - Consider additional features, lagged variables, "
                   "or model tuning")
REC_SALES_COGS_R2 = "Low R² scores for Sales/COGS - Consider ensemble methods or advanced algorithms"
REC_VOLUME_R2 = "Low R² score for Volume - Try more sophisticated models or feature engineering"
REC_SALES_BIAS = "Sales model shows significant bias - Review training data or add bias correction"
REC_COGS_BIAS = "COGS model shows significant bias - Review training data or add bias correction"
REC_VOLUME_BIAS = "Volume model shows significant bias - Review training data or add bias correction"
REC_GENERAL = [
    "Implement regular model retraining (monthly/quarterly)",
    "Monitor prediction accuracy on new data continuously",
    "Consider A/B testing predictions against business forecasts",
    "Set up automated alerts for accuracy degradation",
    "Validate model performance across different market conditions",
]
REC_LIMIT = 10
# Recommendation texts (console variant), in order.
CONSOLE_SALES_MAPE = "Sales model may benefit from additional features or hyperparameter tuning"
CONSOLE_COGS_MAPE = "COGS model may need more training data or feature engineering"
CONSOLE_VOLUME_MAPE = "Volume model may benefit from additional features or hyperparameter tuning"
CONSOLE_ANY_R2 = "Consider ensemble methods or more sophisticated algorithms"
CONSOLE_GENERAL = [
    "Regular model retraining recommended (monthly/quarterly)",
    "Monitor prediction accuracy on new data continuously",
    "Consider A/B testing predictions against business forecasts",
]
# Recommendation thresholds.
REC_MAPE_LIMIT = 15.0
REC_R2_LIMIT = 0.7
REC_BIAS_LIMIT = 5.0

# Minimum group sizes of the rolling and segment evaluations.
ROLLING_MIN_ROWS = 10
SEGMENT_MIN_ROWS = 20
SEGMENT_SPAN_DAYS = 180

# Scaffold defaults by column-name rule (generic forecast template).
SCAFFOLD_TARGET_LAG = 1000.0
SCAFFOLD_OTHER_LAG = 100.0
SCAFFOLD_TEMP = 20.0
SCAFFOLD_SPEND = 1000.0
SCAFFOLD_RATE = 1.0
# Lag columns of future rows without history, and the share of volume that its lag takes.
FUTURE_REVENUE_LAG = 300000.0
FUTURE_COGS_LAG = 120000.0
FUTURE_VOLUME_LAG_SHARE = 0.95
# Longest forecast in days.
MAX_HORIZON = 365
# Defaults for features missing at prediction time.
PREDICT_LAG = 1000.0
PREDICT_TEMP = 20.0
PREDICT_RATE = 1.0
CATEGORICAL_DEFAULT = "default"

# ---------------------------------------------------------------------------
# Types
# ---------------------------------------------------------------------------
# Money and quantities are summed as exact decimals and cast to double once.
MONEY = T.DecimalType(24, 6)

SALES_FACT_SCHEMA = T.StructType([
    T.StructField(DATE, T.DateType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(CHANNEL, T.StringType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField(VOLUME, T.DoubleType()),
    T.StructField(REVENUE, T.DoubleType()),
    T.StructField(COGS, T.DoubleType()),
    T.StructField(MARKETING, T.DoubleType()),
    T.StructField(PROMO, T.IntegerType()),
    T.StructField(CONFIDENCE, T.DoubleType()),
    T.StructField(INFLATION, T.DoubleType()),
    T.StructField(TEMPERATURE, T.DoubleType()),
    T.StructField(HOLIDAY, T.IntegerType()),
    T.StructField(COMPETITOR, T.DoubleType()),
])

SCORED_SCHEMA = T.StructType([
    T.StructField("date", T.DateType()),
    T.StructField(COUNTRY, T.StringType()),
    T.StructField(CHANNEL, T.StringType()),
    T.StructField(PRODUCT, T.StringType()),
    T.StructField("target", T.StringType()),
    T.StructField("actual", T.DoubleType()),
    T.StructField("predicted", T.DoubleType()),
])
