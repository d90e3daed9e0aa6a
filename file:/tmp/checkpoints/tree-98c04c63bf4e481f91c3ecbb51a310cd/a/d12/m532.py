x532