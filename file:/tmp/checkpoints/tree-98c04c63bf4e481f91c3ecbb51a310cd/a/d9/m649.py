x649