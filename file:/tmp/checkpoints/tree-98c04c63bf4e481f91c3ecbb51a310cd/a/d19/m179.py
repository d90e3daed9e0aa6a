x179