"""Referral-outreach analytics on PySpark."""
