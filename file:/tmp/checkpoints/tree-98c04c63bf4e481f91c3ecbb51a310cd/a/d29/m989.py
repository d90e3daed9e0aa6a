x989