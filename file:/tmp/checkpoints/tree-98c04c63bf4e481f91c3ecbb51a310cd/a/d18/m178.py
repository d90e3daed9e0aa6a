x178