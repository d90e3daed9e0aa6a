x328