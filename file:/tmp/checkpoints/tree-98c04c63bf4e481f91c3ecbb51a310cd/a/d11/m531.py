x531