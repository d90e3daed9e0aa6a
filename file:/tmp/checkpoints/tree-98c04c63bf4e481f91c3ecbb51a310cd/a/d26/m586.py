x586