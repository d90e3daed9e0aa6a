x505