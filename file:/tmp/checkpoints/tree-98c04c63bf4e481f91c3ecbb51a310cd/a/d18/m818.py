x818