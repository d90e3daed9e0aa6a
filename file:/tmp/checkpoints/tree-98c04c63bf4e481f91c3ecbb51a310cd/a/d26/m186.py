x186