x581