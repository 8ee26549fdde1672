"""Declared schemas.  Column names and types are fixed values: files are read by position."""

from __future__ import annotations

TELECOM = """customerID string, gender string, SeniorCitizen int, Partner string, Dependents string, tenure int,
PhoneService string, MultipleLines string, InternetService string, OnlineSecurity string, OnlineBackup string,
DeviceProtection string, TechSupport string, StreamingTV string, StreamingMovies string, Contract string,
PaperlessBilling string, PaymentMethod string, MonthlyCharges float, TotalCharges string, Churn string"""

#: A delta file carries the day it was loaded, which is not derived from anything else.
TELECOM_DELTA = f"{TELECOM}, load_date string"

DQ_LOG = "run_date string, table_name string, row_count bigint, null_totalcharges bigint, duplicate_customerids bigint, created_ts timestamp"

PRODUCT = "ID int, name string, category string, price float, last_updated string"

TERRITORIES = "SalesTerritoryKey int, Region string, Country string, Continent string"
CATEGORIES = "ProductCategoryKey int, CategoryName string"
SUBCATEGORIES = "ProductSubcategoryKey int, SubcategoryName string, ProductCategoryKey int"
CALENDAR = "Date string"
