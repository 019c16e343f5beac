"""pdcspark: medication-adherence gap analytics as Spark DataFrame operators.

Weekly KPIs, PDC statistics, histograms, compliance splits, market/payer
summaries, monthly trends and CMS star-threshold comparisons over a weekly
adherence fact table.  Every operator is a lazy ``DataFrame -> DataFrame``
built from Spark's own functions; nothing is collected except bounded
parameter lookups (a week date, a month list).
"""

__version__ = "0.1.0"
