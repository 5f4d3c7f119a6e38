"""End-user plans: ranking reports, detections, rule engine, test projections."""
