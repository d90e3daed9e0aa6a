x277