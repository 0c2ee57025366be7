"""Features of one flow, and the row that models are trained on and score, from assembled flows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.functions import text

#: The fields of a flow's own, in order.
FLOW_FIELDS = (
    "duration", "total_packets", "total_bytes", "pps", "bps", "pkt_size_min", "pkt_size_max", "pkt_size_mean", "pkt_size_std", "pkt_size_q25", "pkt_size_q50", "pkt_size_q75",
    "iat_mean", "iat_var", "iat_min", "iat_max", "jitter", "burstiness_ratio", "small_pkt_ratio", "is_tcp", "is_udp", "is_icmp", "dst_port",
    "dns_query_count", "dns_max_domain_entropy", "dns_max_subdomain_depth", "tls_client_hello_count", "tls_max_sni_entropy", "tls_max_sni_length", "has_syn", "has_fin", "has_rst",
)
#: What the store of windows adds to them, in order.
STORE_FIELDS = (
    "reverse_seen", "egress_bytes", "outbound_inbound_byte_ratio", "off_hours", "src_flows_w", "src_distinct_dsts_w", "src_distinct_dst_ports_w", "src_syn_only_ratio_w",
    "src_periodic_dsts_w", "src_egress_bytes_z", "src_dns_queries_w", "src_distinct_qnames_w", "src_high_entropy_qnames_w", "src_qname_len_sum_w", "src_nxdomain_rate_w",
    "dst_flows_w", "dst_bytes_w", "dst_distinct_srcs_w", "dst_src_ip_entropy_w", "dst_syn_only_ratio_w", "dst_reflector_flows_w", "dst_reflector_bytes_w", "dst_reflector_mean_pkt_w",
    "dst_bytes_vs_baseline", "dst_flows_vs_baseline", "dst_distinct_srcs_longterm", "pair_flows_w", "pair_iat_mean", "pair_iat_cv", "pair_iat_n", "pair_history_count", "ja4_prevalence",
)
#: All columns of a model row: 65.
MODEL_ROW = (*FLOW_FIELDS, "dst_port_class", *STORE_FIELDS)
#: What of a model row the models do not read: names of a host or service, contents that header-only captures lack, and what
#: depends on the place's own networks and clock.
NOT_LEARNED = {
    "dst_port", "dns_query_count", "dns_max_domain_entropy", "dns_max_subdomain_depth", "tls_client_hello_count", "tls_max_sni_entropy", "tls_max_sni_length", "egress_bytes", "outbound_inbound_byte_ratio", "off_hours",
    "src_egress_bytes_z", "src_dns_queries_w", "src_distinct_qnames_w", "src_high_entropy_qnames_w", "src_qname_len_sum_w", "src_nxdomain_rate_w", "ja4_prevalence",
}
LEARNED = tuple(c for c in MODEL_ROW if c not in NOT_LEARNED)


def rates(count: Column, span: Column) -> Column:
    """Per second; of a flow without a span, the count itself."""
    return F.when(span > 0, count / span).otherwise(count.cast("double"))


def size_fields(mean: str = "pkt_size_mean", std: str = "pkt_size_std") -> Column:
    return F.col(std) / (F.col(mean) + F.lit(1e-6))


def most(values: Column, of) -> Column:
    """The largest of a function over an array; 0 of an empty one."""
    return F.coalesce(F.array_max(F.transform(values, of)), F.lit(0)).cast("double")


def port_class(port: Column, protocol: Column) -> Column:
    """0: of a protocol without ports; 1: under 1024, 2: under 49152, 3: from there on."""
    return F.when(~protocol.isin("TCP", "UDP"), 0.0).when(port < 1024, 1.0).when(port < 49152, 2.0).otherwise(3.0)


def flow_fields(flows: DataFrame) -> DataFrame:
    """flows (of assemble_capture()) with FLOW_FIELDS and dst_port_class, as doubles. A flow without packet sizes or gaps has 0 there."""
    span = F.greatest(F.col("last_time") - F.col("start_time"), F.lit(0.0))
    name = F.upper(F.coalesce("protocol", F.lit("")))
    bit = lambda b: (F.col("tcp_flags_seen").bitwiseAND(b) != 0).cast("double")
    names, hosts = F.coalesce("dns_queries", F.array().cast("array<string>")), F.coalesce("tls_snis", F.array().cast("array<string>"))
    made = {
        "duration": span, "total_packets": F.col("packet_count"), "pps": rates(F.col("packet_count"), span), "bps": rates(F.col("total_bytes"), span),
        **{f"pkt_size_q{q}": F.col("pkt_size_q")[i] for i, q in enumerate((25, 50, 75))},
        **{f"iat_{x}": F.col(f"flow_iat_{x}") for x in ("mean", "var", "min", "max")},
        "burstiness_ratio": size_fields(), "small_pkt_ratio": F.col("small_packets") / F.col("packet_count"),
        **{f"is_{p.lower()}": name.contains(p).cast("double") for p in ("TCP", "UDP", "ICMP")},
        "dns_query_count": F.size(names), "dns_max_domain_entropy": most(names, text.entropy), "dns_max_subdomain_depth": most(names, lambda q: F.length(q) - F.length(F.replace(q, F.lit("."), F.lit("")))),
        "tls_client_hello_count": F.size(hosts), "tls_max_sni_entropy": most(hosts, text.entropy), "tls_max_sni_length": most(hosts, F.length),
        "has_syn": bit(2), "has_fin": bit(1), "has_rst": bit(4), "dst_port_class": port_class(F.col("dst_port"), F.col("protocol")),
    }
    out = flows.withColumns({f"__t_{k}": v for k, v in made.items()}).drop(*[k for k in made if k in flows.columns])
    out = out.withColumnsRenamed({f"__t_{k}": k for k in made})
    return out.withColumns({c: F.col(c).cast("double") for c in (*FLOW_FIELDS, "dst_port_class") if c != "total_bytes" and c != "dst_port"})


def model_row(features: DataFrame, keep: list[str]) -> DataFrame:
    """keep and the columns of MODEL_ROW as doubles: the same code makes the rows to learn from and those to score. What is undefined
    (a baseline that is not warm, a half that was not seen) is null, never 0."""
    return features.select(*keep, *[F.col(c).cast("double").alias(c) for c in MODEL_ROW])
