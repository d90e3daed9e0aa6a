x453