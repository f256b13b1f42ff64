"""The profile table as the checks expect it, spelled out and not derived from the package."""

PROFILE_ROWS = """values
  ('strict', 'Generic Broadcaster (EBU R128 / R37)', '2a39001b', -23.0e0, 1.0e0, -1.0e0, 2.0e0, 0.0e0, 0.1e0, 0.5e0, 0, true, 22.0e0, true, 1.0e0, 55.0e0, 35.0e0, 55.0e0, 75.0e0, 1.0e0),
  ('netflix_hd', 'Netflix Delivery Spec v9.1 (HD/UHD)', '785f84ea', -24.0e0, 2.0e0, -2.0e0, 0.5e0, 0.05e0, 0.05e0, 0.0e0, 0, true, 40.0e0, true, 1.0e0, 50.0e0, 30.0e0, 50.0e0, 70.0e0, 1.0e0),
  ('youtube', 'YouTube / Web Upload (Loose)', '6bbd4585', -14.0e0, 3.0e0, 0.0e0, 5.0e0, -0.1e0, 0.2e0, 2.0e0, 15, false, 100.0e0, true, 0.5e0, 65.0e0, 45.0e0, 65.0e0, 85.0e0, 2.0e0),
  ('ott', 'General OTT (Amazon/Hulu)', '3e7a05c8', -24.0e0, cast(null as double), cast(null as double), cast(null as double), cast(null as double), cast(null as double), cast(null as double), cast(null as int), cast(null as boolean), cast(null as double), true, cast(null as double), 55.0e0, cast(null as double), cast(null as double), cast(null as double), cast(null as double))"""
