"""The analyses by identifier: what they take, and how to find and run them."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame

from ..operators import compare, describe, multivar, nonparam, prep, regress, space, survival, timeseries, trees


@dataclass(frozen=True)
class Analysis:
    id: str
    title: str
    category: str
    run: Callable


def _analyses() -> list[Analysis]:
    d, c, r, m, s = "descriptive", "comparison", "correlation and regression", "multivariate", "series and survival"
    rows = [
        ("deskriptif", "Descriptive statistics", d, describe.describe), ("frekuensi", "Frequencies", d, describe.frequencies), ("distribusi", "Histogram", d, describe.histogram), ("agregat", "Aggregate", d, describe.aggregate),
        ("kmeans", "k-means", m, multivar.kmeans), ("rasio", "Ratio statistics", d, describe.ratio), ("merge_files", "Merge files", d, prep.merge_cases), ("merge_variables", "Merge by position", d, prep.merge_variables), ("means", "Means", d, describe.means),
        ("count_values", "Count values", d, describe.count_values), ("explore", "Explore", d, describe.explore), ("codebook", "Codebook", d, describe.codebook), ("pie", "Pie", d, describe.pie), ("error_bar", "Error bars", d, describe.error_bar),
        ("transpose", "Transpose", d, prep.transpose), ("t_satu", "One-sample t", c, compare.t_one), ("t_bebas", "Independent t", c, compare.t_independent), ("t_pasangan", "Paired t", c, compare.t_paired), ("anova", "One-way analysis of variance", c, compare.anova),
        ("anova_dua_faktor", "Two-way analysis of variance", c, compare.anova_two_way), ("mannwhitney", "Mann-Whitney", c, nonparam.mann_whitney), ("wilcoxon", "Wilcoxon signed ranks", c, nonparam.wilcoxon), ("tanda", "Sign test", c, nonparam.sign_test), ("mcnemar", "McNemar", c, nonparam.mcnemar),
        ("kendall_w", "Kendall's W", c, nonparam.kendall_w), ("cochran_q", "Cochran's Q", c, nonparam.cochran_q), ("kruskal", "Kruskal-Wallis", c, nonparam.kruskal), ("levene", "Levene", c, compare.levene), ("prop_satu", "One proportion", c, nonparam.proportion),
        ("prop_dua", "Two proportions", c, nonparam.two_proportions), ("moses", "Moses extreme reactions", c, nonparam.moses), ("ks_dua", "Two-sample Kolmogorov-Smirnov", c, nonparam.ks_two), ("median_test", "Median test", c, nonparam.median_test), ("korelasi", "Pearson correlation", r, regress.pearson),
        ("korelasi_spearman", "Spearman correlation", r, regress.spearman), ("korelasi_kendall", "Kendall's tau-b", r, regress.kendall), ("korelasi_parsial", "Partial correlation", r, regress.partial_correlation), ("logistik", "Logistic regression", r, regress.logistic), ("friedman", "Friedman", c, nonparam.friedman),
        ("runs", "Runs test", c, nonparam.runs_test), ("binomial", "Binomial test", c, nonparam.binomial), ("ks_satu", "Kolmogorov-Smirnov for normality", c, nonparam.ks_normal), ("regresi", "Linear regression", r, regress.ols), ("ridge", "Ridge regression", r, regress.ridge),
        ("probit", "Probit regression", r, regress.probit), ("multinomial", "Multinomial regression", r, regress.multinomial), ("ordinal", "Ordinal regression", r, regress.ordinal), ("silang", "Crosstab", c, describe.association), ("chi_gof", "Goodness of fit", c, describe.chi_gof),
        ("reliabilitas", "Reliability", m, multivar.reliability), ("faktor", "Factor analysis", m, multivar.factor), ("hierarki", "Hierarchical clusters", m, multivar.hierarchical), ("roc", "ROC curve", s, survival.roc), ("plot_sebaran", "Q-Q and P-P plots", d, nonparam.qq_points),
        ("kaplan_meier", "Kaplan-Meier", s, survival.kaplan_meier), ("acf_pacf", "Autocorrelations", s, timeseries.acf_pacf), ("bootstrap", "Bootstrap", c, compare.bootstrap), ("wls", "Weighted least squares", r, regress.wls), ("poisson", "Poisson regression", r, regress.poisson),
        ("ancova", "Analysis of covariance", c, compare.ancova), ("regresi_nonlinear", "Nonlinear curves", r, regress.nonlinear), ("quantile", "Quantile regression", r, regress.quantile_regression), ("glm_multi", "Gamma model", r, regress.glm_gamma), ("glm_binomial", "Binomial model", r, regress.glm_binomial),
        ("campur", "Linear mixed model", r, regress.mixed), ("glmm", "Generalised mixed model", r, regress.glmm), ("chaid", "CHAID", m, trees.chaid), ("c45", "C4.5", m, trees.c45), ("boosting", "Boosting", m, trees.boosting), ("imputasi", "Multiple imputation", s, trees.impute),
        ("cox", "Cox regression", s, survival.cox), ("musiman", "Seasonal decomposition", s, timeseries.decompose), ("holt_winters", "Holt-Winters", s, timeseries.holt_winters), ("korespondensi", "Correspondence analysis", m, multivar.correspondence), ("princals", "Optimal scaling", m, multivar.princals),
        ("klasifikasi", "Discriminant analysis", m, multivar.discriminant), ("knn", "Nearest neighbours", m, multivar.knn), ("twostep", "Two-step clusters", m, multivar.twostep), ("arima", "ARIMA", s, timeseries.arima), ("pakar", "Tournament of orders", s, timeseries.tournament), ("pohon", "CART", m, trees.cart),
        ("hutan", "Random forest", m, trees.random_forest), ("dbscan", "DBSCAN", m, space.dbscan), ("cacah", "Zero-inflated counts", r, regress.zero_inflated), ("cacah_nb", "Negative binomial", r, regress.negative_binomial), ("robust", "Robust regression", r, regress.robust), ("gee", "Marginal models", r, regress.gee),
        ("validasi", "Validation rules", d, prep.validate), ("eksak", "Exact tables", c, nonparam.exact_table), ("sls2", "Two-stage least squares", r, regress.two_stage), ("manova", "Multivariate analysis of variance", c, compare.manova), ("anova_berulang", "Repeated measures", c, compare.anova_repeated),
        ("korelasi_kanonik", "Canonical correlation", r, regress.canonical_correlation), ("custom_tables", "Custom tables", d, describe.custom_table),
    ]
    return [Analysis(*x) for x in rows]


REGISTRY: dict[str, Analysis] = {a.id: a for a in _analyses()}


def search(words: str) -> list[Analysis]:
    """Analyses whose identifier, title or category holds all the words, in any case."""
    parts = words.lower().split()
    return [a for a in REGISTRY.values() if all(p in f"{a.id} {a.title} {a.category}".lower() for p in parts)]


def run(name: str, df: DataFrame, *args, **options):
    """The analysis of that identifier; a KeyError names the nearest ones."""
    if name not in REGISTRY:
        raise KeyError(f"no analysis {name!r}; similar: {[a.id for a in search(name[:4])]}")
    return REGISTRY[name].run(df, *args, **options)
