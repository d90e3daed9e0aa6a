x244